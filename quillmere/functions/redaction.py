"""Secrets and personal data: ordered rules, each on the output of the one before."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    replacement: str
    personal: bool = False
    #: What a text must hold for the pattern to match: one of these in lower case, or a plainer pattern.
    holds: tuple[str, ...] = ()
    plainer: str = ""

    def may_match(self, text: Column) -> Column:
        """False only where the pattern can't match: spares most texts the pattern itself."""
        low = F.lower(text)
        tests = [F.contains(low, F.lit(h)) for h in self.holds] + ([text.rlike(self.plainer)] if self.plainer else [])
        return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


#: Kinds, patterns and replacements in the order in which they apply.
RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |OPENSSH |EC )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]", holds=("private key-----",)),
    Rule("authorization_header", r"(?i)(\bAuthorization\s*:\s*)(?:Bearer|Basic|Token)\s+[A-Za-z0-9._~+/=-]{4,}", "$1[REDACTED_SECRET]", holds=("authorization",)),
    Rule("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}\b", "Bearer [REDACTED_SECRET]", holds=("bearer",)),
    Rule(
        "secret_assignment",
        r"""(?i)(["']?(?:api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|app[_-]?token|password|passwd|pwd|cookie|session[_-]?token)["']?\s*[:=]\s*["']?)[^&"'\s<},]{4,}""",
        "$1[REDACTED_SECRET]",
        holds=("key", "secret", "token", "password", "passwd", "pwd", "cookie"),
    ),
    Rule("openai_style_key", r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED_SECRET]", holds=("sk-",)),
    Rule("github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED_SECRET]", holds=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("aws_access_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[REDACTED_SECRET]", holds=("akia", "asia")),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b", "[REDACTED_SECRET]", holds=("eyj",)),
    Rule("phone", r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)", "[REDACTED_PHONE]", True, plainer=r"1[3-9]\d{9}"),
    Rule("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]", True, holds=("@",)),
    Rule("id_number", r"\b\d{17}[\dXx]\b", "[REDACTED_ID_NUMBER]", True, plainer=r"\d{17}"),
)

#: What a candidate may not hold at all.
SECRET_LIKE = (
    r"""(?i)api[_-]?key\s*=\s*["']?[a-z0-9_-]{20,}""",
    r"""(?i)token\s*=\s*["']?[a-z0-9_.-]{20,}""",
    r"(?i)sk-[a-z0-9]{20,}",
    r"-----BEGIN (RSA |OPENSSH |EC )?PRIVATE KEY-----",
)


def redact(df: DataFrame, column: str, personal: bool = True, out: str = "redacted", counts: str = "redactions") -> DataFrame:
    """Add `out` (redacted text) and `counts` (map of kind to number, kinds that occur only). Null stays null."""
    rules = [r for r in RULES if personal or not r.personal]
    names = df.columns
    df = df.withColumn("_t", F.struct(F.col(column).alias("text"), F.array().cast("array<bigint>").alias("counts")))
    for rule in rules:
        count = F.coalesce(F.regexp_count("_t.text", F.lit(rule.pattern)), F.lit(0)).cast("long")
        changed = F.struct(F.regexp_replace("_t.text", rule.pattern, rule.replacement).alias("text"), F.array_append("_t.counts", count).alias("counts"))
        step = F.when(rule.may_match(F.col("_t.text")), changed).otherwise(F.struct(F.col("_t.text").alias("text"), F.array_append("_t.counts", F.lit(0).cast("long")).alias("counts")))
        # one element a row: keeps the steps apart, else each would compute those below it again
        df = df.select(*names, F.explode(F.array(step)).alias("_t"))
    found = F.map_from_arrays(F.array(*[F.lit(r.kind) for r in rules]), F.col("_t.counts"))
    return df.withColumn(out, F.col("_t.text")).withColumn(counts, F.map_filter(found, lambda _, n: n > 0)).drop("_t")


def redact_error(text: Column, longest: int = 500) -> Column:
    """An error message without secrets and personal data, cut."""
    for rule in RULES:
        text = F.regexp_replace(text, rule.pattern, rule.replacement)
    return F.substring(text, 1, longest)


def has_secret(text: Column) -> Column:
    """Whether a text (or a row's JSON) holds what may never be stored."""
    out = F.lit(False)
    for pattern in SECRET_LIKE:
        out = out | text.rlike(pattern)
    return out
