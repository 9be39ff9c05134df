"""References in marked-up texts: media in order, links to published assets, and files of assets."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.text import clean_export, short_hash
from quillmere.sources.store import local

#: Media elements, the attribute that holds their handle, and the kind they stand for.
MEDIA = {"img": ("src", "image"), "source": ("token", "attachment"), "whiteboard": ("token", "whiteboard")}
#: Where published files lie, how they are named, and the scheme that names them.
OBJECTS, ASSET, SCHEME = "knowledge/assets/objects/", r"asset_sha256_[a-f0-9]{64}", "asset://"
#: A fenced block: a line of three or more backticks or tildes, up to a line of as many or more of the same, or to the end.
_FENCE = r"(?m)^[ \t]{0,3}(?:(`{3,}+)[^\n]*(?:\n|\z)(?s:.*?)(?:^[ \t]{0,3}\1`*[ \t]*(?:\n|\z)|\z)|(~{3,}+)[^\n]*(?:\n|\z)(?s:.*?)(?:^[ \t]{0,3}\2~*[ \t]*(?:\n|\z)|\z))"


def rewritten(text: Column, pattern: str, change: Callable[[Column, Column], Column]) -> Column:
    """`text` with every match of `pattern` put as change(match, number from 0): its pieces and matches laid side by side."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    changed = F.concat(F.transform(found, change), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, changed, lambda a, b: F.concat(a, b)), "")


def outside_fences(text: Column, change: Callable[[Column], Column]) -> Column:
    """`text` with change() put on what lies outside fenced code; code stays as it is."""
    prose, code = F.split(text, _FENCE, -1), F.regexp_extract_all(text, F.lit(_FENCE), F.lit(0))
    return F.array_join(F.zip_with(F.transform(prose, change), F.concat(code, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def prose_of(text: Column) -> Column:
    """The texts outside fenced code, in order."""
    return F.split(text, _FENCE, -1)


# --------------------------------------------------------------------------- media


_REFERENCES = "array<struct<ordinal: int, kind: string, handle: string, reference_id: string, name: string, alt: string, mime: string>>"


def _attribute(tag: Column, name: Column | str) -> Column:
    """An attribute's value in double quotes; null where it isn't there."""
    pattern = F.concat(F.lit(r'(?s)[\s"]'), F.lit(name) if isinstance(name, str) else name, F.lit(r'\s*=\s*"([^"]*)"'))
    return F.get(F.regexp_extract_all(tag, pattern, F.lit(1)), F.lit(0))


def media(docs: DataFrame, elements: dict[str, str] | None = None, key: str = "key", content: str = "content") -> DataFrame:
    """(key, ordinal, element, handle, occurrence): media elements of each text in order.

    ordinal counts a text's elements from 0; occurrence counts those of one handle, from 1. An
    element without its attribute has a null handle and occurrence. Texts are scanned in their
    own rows, and nothing is shuffled.
    """
    elements = elements or {k: v[0] for k, v in MEDIA.items()}
    names = F.create_map(*[F.lit(x) for pair in elements.items() for x in pair])
    found = F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(rf"(?s)<(?:{'|'.join(elements)})\b[^>]*>"), F.lit(0))
    element = lambda tag: F.regexp_extract(tag, r"^<(\w+)", 1)
    rows = docs.select(F.col(key).alias("key"), F.transform(found, lambda tag: F.struct(element(tag).alias("element"), _attribute(tag, names[element(tag)]).alias("handle"))).alias("_all"))
    rows = rows.select("key", "_all", F.posexplode("_all").alias("ordinal", "_m"))
    before = F.size(F.filter(F.slice("_all", 1, F.col("ordinal") + 1), lambda m: m["handle"] == F.col("_m.handle")))
    return rows.select("key", "ordinal", "_m.element", "_m.handle", F.when(F.col("_m.handle").isNotNull(), before).alias("occurrence"))


def _escaped(value: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(mark), F.lit(entity))
    return value


def normalise_export(docs: DataFrame, references: DataFrame, connector: str, private_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(key, text, error): exported texts with references to sources in place of media, cleaned of handles and people.

    docs: key, content. references: key, ordinal, kind, handle, reference_id, name, alt, mime; the
    n-th element must be the reference of ordinal n, of its kind and handle, and there must be as
    many. A text whose references do not fit has a null text and says which was first. Handles
    are compared and never written.
    """
    tags = {name: kind for name, (_, kind) in MEDIA.items()}
    kinds, handles = (F.create_map(*[F.lit(x) for pair in p.items() for x in pair]) for p in (tags, {k: v[0] for k, v in MEDIA.items()}))
    own = references.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "handle", "reference_id", "name", "alt", "mime"))).alias("_refs"))  # a document's own references
    pattern = rf"(?s)<(?:{'|'.join(MEDIA)})\b[^>]*>"
    rows = docs.select("key", F.coalesce("content", F.lit("")).alias("_text")).join(own, F.col("key") == F.col("_key"), "left")
    rows = rows.withColumn("_refs", F.coalesce(F.col("_refs").cast(_REFERENCES), F.array().cast(_REFERENCES))).withColumn("_tags", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    element = lambda tag: F.regexp_extract(tag, r"^<(\w+)", 1)
    fits = lambda tag, n: (F.get("_refs", n)["ordinal"] == n) & (F.get("_refs", n)["kind"] == kinds[element(tag)]) & F.get("_refs", n)["handle"].eqNullSafe(_attribute(tag, handles[element(tag)]))
    wrong = F.filter(F.transform("_tags", lambda tag, n: F.when(~F.coalesce(fits(tag, n), F.lit(False)), n)), lambda n: n.isNotNull())
    error = F.when(F.size("_tags") != F.size("_refs"), F.concat(F.lit("media references do not match content: "), F.size("_refs"), F.lit(" for "), F.size("_tags"))).when(F.size(wrong) > 0, F.concat(F.lit("media reference mismatch at "), F.get(wrong, F.lit(0))))
    part = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f' {name}="'), _escaped(value), F.lit('"'))).otherwise("")

    def reference(_: Column, n: Column) -> Column:
        r = F.get("_refs", n)
        source = short_hash("src_", 24, F.lit(connector), F.col("key"), r["reference_id"])
        return F.concat(F.lit('<asset-ref source-id="'), source, F.lit('" kind="'), r["kind"], F.lit('"'), part("name", r["name"]), part("alt", r["alt"]), part("content-type", r["mime"]), F.lit("/>"))

    text = clean_export(rewritten(F.col("_text"), pattern, reference), private_hosts)
    return rows.select("key", F.when(error.isNull(), text).alias("text"), error.alias("error"))


# --------------------------------------------------------------------------- links to assets


def relative_link(document: Column, target: Column) -> Column:
    """The link from a document's path to a file's, both below the same root; begins with a dot."""
    here, there = F.split(document, "/"), F.split(target, "/")
    folder = F.slice(here, 1, F.size(here) - 1)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(folder), F.lit(1))), lambda n: F.slice(folder, 1, n) == F.slice(there, 1, n)))
    same = F.when(F.size(folder) == 0, 0).otherwise(same)
    up = F.repeat(F.lit("../"), F.size(folder) - same)
    rest = F.array_join(F.slice(there, same + 1, F.greatest(F.size(there) - same, F.lit(0))), "/")
    return F.when(up == "", F.concat(F.lit("./"), rest)).otherwise(F.concat(up, rest))


def _joined(folder: Column, link: Column) -> Column:
    """A link's path from a folder, with `.` and `..` taken up."""
    parts = F.concat(folder, F.split(link, "/"))
    up = lambda done: F.when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, F.lit("..")))
    taken = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p.isin(".", ""), done).when(p == "..", up(done)).otherwise(F.array_append(done, p)))
    return F.array_join(taken, "/")


def _with_assets(docs: DataFrame, ids: Column, assets: DataFrame) -> DataFrame:
    """docs with `_assets`, a map from the ids that a text names to their paths; only those ids meet the table of assets."""
    wanted = docs.select("path", F.explode(F.array_distinct(ids)).alias("asset_id")).distinct()
    found = wanted.join(assets.groupBy("asset_id").agg(F.min("relative_path").alias("relative_path")), "asset_id").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("asset_id", "relative_path"))).alias("_assets"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return docs.join(found, "path", "left").withColumn("_assets", F.coalesce("_assets", empty))


_LINK = rf"!?\[[^\]\n]*\]\({SCHEME}{ASSET}\)"
_RELATIVE = r"!?\[[^\]\n]*\]\(\.\.?/[^)\s]+\)"


def resolve_assets(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, body, error): documents with links to assets in place of their URIs, outside fenced code.

    docs: path (one row each), body. assets: asset_id, relative_path. Only a whole Markdown link
    or image is resolved; a URI left over in prose, an asset that isn't there and a path outside
    `knowledge/` are errors, and then the body is null.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    prose = F.array_join(prose_of(body), "\n")
    rows = _with_assets(docs.select("path", body.alias("body")), F.regexp_extract_all(prose, F.lit(rf"\({SCHEME}({ASSET})\)"), F.lit(1)), assets)
    identity = lambda m: F.regexp_extract(m, rf"{SCHEME}({ASSET})\)$", 1)

    def link(match: Column, _: Column) -> Column:
        return F.concat(F.regexp_extract(match, r"(?s)^(!?\[[^\]\n]*\]\()", 1), relative_link(F.col("path"), F.col("_assets")[identity(match)]), F.lit(")"))

    named = F.regexp_extract_all(F.array_join(prose_of(F.col("body")), "\n"), F.lit(_LINK), F.lit(0))
    missing = F.filter(F.transform(named, identity), lambda a: ~F.map_contains_key("_assets", a))
    left = F.exists(prose_of(F.col("body")), lambda p: F.contains(F.regexp_replace(p, _LINK, ""), F.lit(SCHEME)))
    error = F.when(~F.startswith("path", F.lit("knowledge/")), "path is not in the workspace").when(F.size(missing) > 0, F.concat(F.lit("no asset "), F.get(missing, F.lit(0)))).when(left, "an asset's URI must be a Markdown link or image")
    return rows.select("path", F.when(error.isNull(), outside_fences(F.col("body"), lambda p: rewritten(p, _LINK, link))).alias("body"), error.alias("error"))


def relocate_assets(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, body, error): documents moved from `path` to `new_path`, their links to assets led there; other links stay."""
    body, place = F.coalesce(F.col("body"), F.lit("")), F.split("path", "/")
    folder = F.slice(place, 1, F.size(place) - 1)
    target = lambda m: _joined(folder, F.try_url_decode(F.replace(F.regexp_extract(m, r"\]\(([^)\s]+)\)$", 1), F.lit("+"), F.lit("%2B"))))
    identity = lambda p: F.regexp_extract(p, rf"/({ASSET})\.[a-z0-9]+$", 1)
    ours = lambda p: F.coalesce(F.startswith(p, F.lit(OBJECTS)), F.lit(False))
    paths = F.filter(F.transform(F.flatten(F.transform(prose_of(body), lambda p: F.regexp_extract_all(p, F.lit(_RELATIVE), F.lit(0)))), target), ours)
    rows = docs.select("path", "new_path", body.alias("body"), paths.alias("_paths"))
    rows = _with_assets(rows, F.filter(F.transform("_paths", identity), lambda a: a != ""), assets)
    wrong = F.filter("_paths", lambda p: ~F.coalesce(F.col("_assets")[identity(p)] == p, F.lit(False)))

    def link(match: Column, _: Column) -> Column:
        at = target(match)
        return F.when(ours(at), F.concat(F.regexp_extract(match, r"(?s)^(!?\[[^\]\n]*\]\()", 1), relative_link(F.col("new_path"), at), F.lit(")"))).otherwise(match)

    error = F.when(F.size(wrong) > 0, F.concat(F.lit("no published asset: "), F.get(wrong, F.lit(0))))
    # the moved path gets its name last: here `path` is where the links were written
    return rows.select("new_path", F.when(error.isNull(), outside_fences(F.col("body"), lambda p: rewritten(p, _RELATIVE, link))).alias("body"), error.alias("error")).withColumnRenamed("new_path", "path")


# --------------------------------------------------------------------------- published files

#: Kinds of files that may be published, by their beginnings: type, ending, beginning.
MAGIC = (("image/png", "png", b"\x89PNG\r\n\x1a\n"), ("image/jpeg", "jpg", b"\xff\xd8\xff"), ("image/gif", "gif", b"GIF8"), ("application/pdf", "pdf", b"%PDF-"), ("application/zip", "zip", b"PK\x03\x04"))


def kind_of(content: bytes) -> tuple[str, str] | None:
    """(type, ending) that a file's beginning shows."""
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "image/webp", "webp"
    return next(((kind, ending) for kind, ending, head in MAGIC if content.startswith(head)), None)


def publish_assets(files: DataFrame, root: str) -> DataFrame:
    """Write files (source_id, content_type, content) below `root` by their content, and say what became of each.

    (source_id, status, asset_id, relative_path, bytes, error); status is published, there (the same
    bytes were) or refused: a type that may not be published, or bytes that do not begin as it
    says. Tasks write their rows' files: beside their place, then linked to it, which only one of
    several writers can, so the same bytes are one file however often and from wherever they
    come. Nothing is written until the result is computed; keep it, as a second time all is there.
    """
    place = local(root)
    shape = "source_id string, status string, asset_id string, relative_path string, bytes long, error string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in shape.split(", ")]
        for rb in batches:
            out = []
            for source, said, content in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                kind = kind_of(content or b"")
                if kind is None or kind[0] != (said or "").lower():
                    out.append((source, "refused", None, None, len(content or b""), f"not published as {said}" if kind is None else f"{said} begins as {kind[0]}"))
                    continue
                digest = hashlib.sha256(content).hexdigest()
                relative = f"{OBJECTS}{digest[:2]}/asset_sha256_{digest}.{kind[1]}"
                target, draft = f"{place}/{relative}", f"{place}/{OBJECTS}{digest[:2]}/.{uuid.uuid4().hex}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(draft, "wb") as f:
                    f.write(content)
                try:
                    os.link(draft, target)
                    status = "published"
                except FileExistsError:
                    status = "there"
                finally:
                    os.unlink(draft)
                with open(target, "rb") as f:
                    intact = hashlib.file_digest(f, "sha256").hexdigest() == digest
                out.append((source, status if intact else "refused", f"asset_sha256_{digest}", relative, len(content), None if intact else "the file that is there has other bytes"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if n == "bytes" else pa.string()) for k, n in enumerate(names)], names)

    return files.select("source_id", "content_type", "content").mapInArrow(work, shape)
