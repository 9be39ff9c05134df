"""Tokens, labels, summaries and sizes of texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKENS, MAX_NGRAMS = 48, 96


def _none() -> Column:
    return F.array().cast("array<string>")


def grams(run: Column, n: int) -> Column:
    """Substrings of n characters of a text, in order; none if it is shorter."""
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1))), lambda i: F.substr(run, i, F.lit(n)))).otherwise(_none())


def cjk_ngrams(text: Column, most: int | None = MAX_NGRAMS) -> Column:
    """For each run of Han characters all pairs, then all triples; distinct, the first `most` (None: all)."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{IsHan}+)"), F.lit(1))
    every = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3)))))
    return every if most is None else F.slice(every, 1, most)


def terms(text: Column, shortest: int = 2) -> Column:
    """Lower-case terms outside Han runs: letters, digits, `_`, `/`, `-`; at least `shortest` long, repeats kept."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{IsHan}+", " ")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_/-]+"), lambda t: F.length(t) >= shortest)


def query_tokens(text: Column, most: int = MAX_TOKENS) -> Column:
    """Distinct terms and then Han n-grams, the first `most`."""
    return F.slice(F.array_distinct(F.concat(terms(text), cjk_ngrams(text))), 1, most)


def bag_terms(text: Column) -> Column:
    """Terms for the local term vector: Han runs stay terms, n-grams follow, repeats kept."""
    own = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_/-]+"), lambda t: F.length(t) >= 2)
    return F.concat(own, cjk_ngrams(text))


def embedding_tokens(text: Column, longest: int = 48) -> Column:
    """Distinct tokens of 2 to `longest` characters for the hashing embedder."""
    return F.array_distinct(F.filter(bag_terms(text), lambda t: F.length(t) <= longest))


def without_accents(text: Column) -> Column:
    """Canonical decomposition (NFD, by the ICU that Spark brings) without combining marks.

    Spark takes a reflected call for non-deterministic: it may stand in a select, not in an aggregate.
    """
    return F.regexp_replace(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(False)), r"\p{M}+", "")


def index_terms(text: Column) -> Column:
    """Tokens of an indexed text: accents removed, lower case, runs of letters and digits, repeats kept."""
    return F.filter(F.split(without_accents(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def adjacent_pairs(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(pairs, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def normalise_label(text: Column) -> Column:
    """Trimmed, lower case, blanks and underscores as `-`, runs of `-` as one."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[_\s]+", "-"), "-+", "-")


def label_segments(text: Column) -> Column:
    return F.filter(F.split(normalise_label(text), "[/-]+"), lambda s: s != "")


def normalise_alias(text: Column) -> Column:
    """Trimmed, lower case, runs of blanks as one."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column) -> Column:
    """A Han character is a token; of the rest, four UTF-16 units are one, rounded up."""
    han = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{IsHan}]", "")).cast("long")
    return han + F.ceil(F.greatest(utf16_length(text) - han, F.lit(0)) / 4)


def summary(body: Column, longest: int = 500) -> Column:
    """Body without its first level-one heading and fenced code, blanks collapsed, cut with an ellipsis."""
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)```.*?```", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"^\s*#\s+[^\n]*\n?", ""), r"\s+", " "))
    return F.when(F.length(plain) > longest, F.concat(F.rtrim(F.substring(plain, 1, longest - 1)), F.lit("…"))).otherwise(plain)


#: Entities and what they stand for, in the order in which they are decoded. A numeric one is a blank.
ENTITIES = (("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def strip_markup(text: Column) -> Column:
    """Tags out, the five named entities decoded in turn (so `&amp;lt;` becomes `<`), numeric ones blank, blanks collapsed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for name, mark in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"&#\d+;", " "), r"\s+", " "))


#: What an export loses, in this order; one more rule, for links of the exporting host, is the caller's.
EXPORT_RULES = (
    (r'\s+id="[^"]*"', ""),
    (r'\s+src="[^"]*"', ""),
    (r'\s+token="[^"]*"', ""),
    (r'(?is)<cite\b[^>]*\btype="user"[^>]*>.*?</cite>', "[REDACTED_PERSON]"),
    (r'(?i)<cite\b[^>]*\btype="user"[^>]*/?>', "[REDACTED_PERSON]"),
    (r'\s+doc-id="([^"]*)"', ' doc-ref="$1"'),
    (r'\s+src-token="([^"]*)"', ' doc-ref="$1"'),
    (r'\s+src-block-id="[^"]*"', ""),
)


def clean_export(text: Column, private_hosts: tuple[str, ...] = ()) -> Column:
    """Markup of an export without ids, download handles and people; references to documents stay under one name.

    private_hosts: beginnings of host names whose links are download handles and go as well.
    """
    for host in private_hosts:
        text = F.regexp_replace(text, r'\s+href="https://\Q' + host + r'\E[^"]*"', "")
    for pattern, replacement in EXPORT_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def slug(text: Column, longest: int = 80) -> Column:
    """Lower case, everything but letters and digits as `-`, no `-` at the ends, cut."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, longest), "-+$", "")


def snake(text: Column) -> Column:
    """camelCase and dashes to snake_case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))


def mermaid_label(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), '"', "'"), r"[\r\n\[\]]+", " ")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def short_hash(prefix: str, length: int, *parts: Column) -> Column:
    """prefix + the first `length` hex digits of sha256 over the parts joined by a zero character."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, length))
