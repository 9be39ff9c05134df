"""Ingestion from a connector into stores, counted in the pass that writes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import redaction
from quillmere.operators import ingestion
from quillmere.sources import store
from quillmere.sources.connectors import NONE, PERSONAL, SECRETS, Connector
from quillmere.storage import discard, settle

_STRENGTH = {NONE: 0, SECRETS: 1, PERSONAL: 2}
_VERSION = "struct<" + ", ".join(f"{s}: string" for s in ingestion.SIGNALS) + ">"
_SECTIONS = "array<struct<section_id: string, heading_path: array<string>, char_start: int, char_end: int, text_hash: string>>"
#: Columns of a source's manifest.
MANIFEST = (
    f"source_id string, connector_id string, external_key string, title string, content_type string, project_keys array<string>, availability string, content_hash string, fingerprint string, version {_VERSION}, "
    f"processing_profile string, redaction_policy string, vault_object string, sections {_SECTIONS}, processing_status string, processed_content_hash string, duplicate_of string, refined_knowledge_ids array<string>"
)
#: What a run counts.
COUNTERS = ("discovered", "skipped", "fetched", "failed", "redacted", "bytes")


def profile_of(connector: Connector, policy: str) -> str:
    """What a source was processed with; another profile processes it again."""
    return f"{type(connector).__name__.lower()}:1;redaction={policy}"


@dataclass
class Run:
    """What a run did. jobs: source_id, external_key, state, status (completed, skipped, failed), error, redactions, bytes."""

    counters: dict[str, int]
    jobs: DataFrame
    manifests: DataFrame
    generation: int
    complete: bool
    failures: int = field(default=0)


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path) if store.generations(path) else spark.createDataFrame([], MANIFEST)


def run(spark: SparkSession, connector: Connector, path: str, policy: str = PERSONAL, limit: int | None = None) -> Run:
    """Take in what is new or changed of a connector's sources; `path` holds stores `manifests`, `texts` and `jobs`.

    Sources whose state asks for nothing are skipped without being fetched. The others, with a
    limit the first so many by id, are fetched, normalised, redacted and cut into sections. One
    that fails keeps its manifest and is tried again next time. What a complete inventory does
    not list becomes missing, unless a limit left sources over. A policy weaker than the
    connector's own is refused.

    The counters are observed in the pass that writes the jobs. Each of the three stores is
    committed whole, manifests last and only if no other run has committed since this one began:
    a run that is broken off leaves the manifests as they were, and is done again.
    """
    if policy not in _STRENGTH or _STRENGTH[policy] < _STRENGTH[connector.least_redaction]:
        raise ValueError(f"{connector.connector_id} needs redaction {connector.least_redaction}, not {policy}")
    if limit is not None and (not isinstance(limit, int) or limit < 0):
        raise ValueError("limit is a number of sources")
    generation = (store.generations(f"{path}/manifests") or [0])[-1]
    old = settle(_manifests(spark, f"{path}/manifests"), "manifests")
    own = old.where(F.col("connector_id") == connector.connector_id)
    profile = profile_of(connector, policy)
    probes = settle(connector.probes(spark), "probes")
    held = own.where("availability = 'available'").select(F.col("source_id").alias("vault_id"))  # texts are kept with their manifest
    states = settle(ingestion.check_updates(own.withColumn("vault_object", F.col("source_id")), probes, profile, connector.complete, held), "states")
    todo = states.where("action <> 'none' and state <> 'removed'").select("source_id")
    chosen = todo if limit is None else todo.orderBy("source_id").limit(limit)
    truncated = limit is not None and todo.count() > limit
    contents = settle(connector.contents(spark, chosen), "contents")  # read once: a source may change meanwhile
    texts = connector.normalised(contents)
    plain = texts.withColumn("content_hash", F.sha2("content", 256))
    if policy == NONE:
        plain = plain.withColumn("redacted", F.col("text")).withColumn("redactions", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    else:
        plain = redaction.redact(plain, "text", personal=policy == PERSONAL)
    fetched = settle(plain.select("source_id", "redacted", "redactions", "error", "content_hash"), "fetched")
    here = chosen.withColumn("_chosen", F.lit(True)).join(fetched, "source_id", "left")
    rows = probes.join(states.select("source_id", "state"), "source_id").join(here, "source_id", "left")
    lost = F.col("_chosen") & F.col("error").isNull() & F.col("content_hash").isNull()
    error = F.when(lost, "source went away before it was fetched").otherwise(F.col("error"))
    status = F.when(F.col("_chosen").isNull(), "skipped").when(error.isNotNull(), "failed").otherwise("completed")
    hits = F.aggregate(F.coalesce(F.map_values("redactions"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    jobs = rows.select("source_id", "external_key", "state", status.alias("status"), redaction.redact_error(error).alias("error"), hits.alias("redactions"), "bytes")
    seen = Observation()
    count = lambda test: F.count_if(test)
    jobs = jobs.observe(
        seen, F.count(F.lit(1)).alias("discovered"), count(F.col("status") == "skipped").alias("skipped"), count(F.col("status") == "completed").alias("fetched"), count(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("redactions"), F.lit(0)).alias("redacted"), F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
    store.write(jobs, f"{path}/jobs")
    counters = {k: int(seen.get[k]) for k in COUNTERS}
    done = store.read(spark, f"{path}/jobs")
    good = fetched.where("error is null").select("source_id", "redacted", "content_hash")
    cut = ingestion.sections(good.select("source_id", F.col("redacted").alias("content")))
    own_sections = cut.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "section_id", "heading_path", "char_start", "char_end", "text_hash"))), lambda s: F.struct(*[s[k].alias(k) for k in ("section_id", "heading_path", "char_start", "char_end", "text_hash")])).cast(_SECTIONS).alias("sections"))
    version = F.struct(*[F.col(s).alias(s) for s in ingestion.SIGNALS]).cast(_VERSION)
    none = lambda kind: F.lit(None).cast(kind)
    new = good.join(own_sections, "source_id").join(probes, "source_id").withColumn("version", version).select(
        "source_id", F.lit(connector.connector_id).alias("connector_id"), "external_key", F.element_at(F.split("external_key", "/"), -1).alias("title"), F.lit(connector.content_type).alias("content_type"), F.array(*map(F.lit, connector.project_keys)).cast("array<string>").alias("project_keys"),
        F.lit("available").alias("availability"), "content_hash", ingestion.version("version").alias("fingerprint"), "version", F.lit(profile).alias("processing_profile"), F.lit(policy).alias("redaction_policy"), F.col("source_id").alias("vault_object"), "sections", F.lit("pending").alias("processing_status"),
        none("string").alias("processed_content_hash"), none("string").alias("duplicate_of"), none("array<string>").alias("refined_knowledge_ids"), none("string").alias("error"),
    )
    left_over = done.where("status <> 'completed'").select("source_id")
    stays = own.join(left_over, "source_id", "left_semi").withColumn("error", F.lit("kept as it is"))
    merged = ingestion.ingest(own, new.unionByName(stays.select(*new.columns)), connector.complete and not truncated)
    others = old.where(F.col("connector_id") != connector.connector_id)
    after = settle(others.unionByName(merged.select(*others.columns)), "manifests")
    before = store.read(spark, f"{path}/texts") if store.generations(f"{path}/texts") else spark.createDataFrame([], "source_id string, text string")
    kept = settle(before.join(good.select("source_id"), "source_id", "left_anti").unionByName(good.select("source_id", F.col("redacted").alias("text"))), "texts")
    store.write(kept, f"{path}/texts")
    generation = store.write(after, f"{path}/manifests", generation=generation)
    for df in (old, probes, states, contents, fetched, kept):
        discard(df)
    return Run(counters, done, after, generation, connector.complete and not truncated, counters["failed"])


def refresh(spark: SparkSession, connector: Connector, path: str, policy: str = PERSONAL, passes: int = 3) -> DataFrame:
    """Check, take in and check again until nothing is to be done or `passes` are over: (pass, source_id, state, action).

    Every pass's states that ask for something are rows, so a source that changes while it is
    taken in shows again in the next pass; what still asks for something in the last check, which
    takes nothing in, is there with pass `passes` + 1.
    """
    found = None
    for number in range(1, passes + 2):
        own = _manifests(spark, f"{path}/manifests").where(F.col("connector_id") == connector.connector_id)
        held = own.where("availability = 'available'").select(F.col("source_id").alias("vault_id"))
        states = ingestion.check_updates(own.withColumn("vault_object", F.col("source_id")), connector.probes(spark), profile_of(connector, policy), connector.complete, held)
        open_ = settle(states.where("action <> 'none'").select(F.lit(number).alias("pass"), "source_id", "state", "action"), "open")
        found = open_ if found is None else found.unionByName(open_)
        if number > passes or not open_.limit(1).count():
            return found
        run(spark, connector, path, policy)
    return found
