"""Sources: sections, versions, change classes, update checks, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.text import content_hash, strip_markup

#: Version signals, the most telling first.
SIGNALS = ("path_hash", "commit_sha", "revision", "etag", "opaque_version", "updated_at")
#: Update states and what each asks for.
ACTIONS = {
    "unchanged": "none", "metadata_only": "ingest", "processing_profile_changed": "ingest", "evidence_missing": "ingest", "update_unknown": "ingest_and_verify",
    "new": "ingest_and_distill", "content_changed": "ingest_and_distill", "removed": "ingest_and_distill", "restored": "ingest_and_distill",
}


def sections(pages: DataFrame, key: str = "source_id", content: str = "content", title: str | None = None) -> DataFrame:
    """Sections of marked-up texts: every heading to the next; a text without headings is one section.

    Returns key, position, level, heading_path, char_start, char_end (characters from 0),
    text_hash, section_id. The path of a heading is that of the headings above it: the last one
    of each smaller level since a heading that is above that level. Texts of a page are cut in
    its own row, so nothing is shuffled.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(r"(?is)<h([1-6])\b[^>]*>(?:.*?)</h\1>"), F.lit(0))
    rows = pages.select(F.col(key).alias("_key"), text.alias("_text"), (F.col(title) if title else F.lit("body")).alias("_title"), marks.alias("_marks"))
    empty = F.array().cast("array<struct<at:int,till:int,level:int,title:string>>")
    start = F.struct(F.lit(1).alias("from"), empty.alias("found")).cast("struct<from:int,found:array<struct<at:int,till:int,level:int,title:string>>>")

    def step(s: Column, mark: Column) -> Column:
        at = F.call_function("locate", mark, F.col("_text"), s["from"])
        item = F.struct((at - 1).cast("int").alias("at"), (at - 1 + F.length(mark)).cast("int").alias("till"), F.substring(mark, 3, 1).cast("int").alias("level"), strip_markup(mark).alias("title"))
        return F.struct((at + F.length(mark)).cast("int").alias("from"), F.array_append(s["found"], item).alias("found"))

    found = F.filter(F.aggregate("_marks", start, step)["found"], lambda h: h["title"] != "")
    rows = rows.withColumn("_heads", found)
    below = F.transform("_heads", lambda h, i: F.transform(F.filter(F.sequence(F.lit(1), h["level"]), lambda lv: F.exists(F.slice("_heads", 1, i + 1), lambda g: g["level"] == lv)), lambda lv: F.element_at(F.filter(F.slice("_heads", 1, i + 1), lambda g: g["level"] == lv), -1)))
    # a heading that stands before the last heading of a smaller level is not above the current one
    paths = F.transform(below, lambda c: F.transform(F.filter(c, lambda g: ~F.exists(c, lambda o: (o["level"] < g["level"]) & (o["at"] > g["at"]))), lambda g: g["title"]))
    ends = F.transform("_heads", lambda h, i: F.when(i + 1 < F.size("_heads"), F.get("_heads", i + 1)["at"]).otherwise(F.length("_text")))
    rows = rows.withColumn("_paths", paths).withColumn("_ends", ends)
    each = rows.where(F.size("_heads") > 0).select("_key", "_text", F.posexplode(F.arrays_zip("_heads", "_paths", "_ends")).alias("position", "_z"))
    body = strip_markup(F.substr(F.col("_text"), F.col("_z._heads.till") + 1, F.greatest(F.col("_z._ends") - F.col("_z._heads.till"), F.lit(0))))
    one = each.select("_key", "position", F.col("_z._heads.level").alias("level"), F.col("_z._paths").alias("heading_path"), F.col("_z._heads.at").alias("char_start"), F.greatest(F.col("_z._heads.at") + 1, F.col("_z._ends")).alias("char_end"), F.when(body == "", F.col("_z._heads.title")).otherwise(body).alias("_body"))
    whole = strip_markup(F.col("_text"))
    none = rows.where(F.size("_heads") == 0).select("_key", F.lit(0).alias("position"), F.lit(0).alias("level"), F.array("_title").alias("heading_path"), F.lit(0).alias("char_start"), F.greatest(F.lit(1), F.length("_text")).alias("char_end"), F.when(whole == "", F.col("_title")).otherwise(whole).alias("_body"))
    identity = F.substring(F.sha2(F.to_json(F.struct(F.col("_key").cast("string").alias("source"), F.col("heading_path").alias("path"), F.sha2(F.trim("_body").cast("binary"), 256).alias("text"))).cast("binary"), 256), 1, 20)
    return one.unionByName(none).select(F.col("_key").alias(key), "position", "level", "heading_path", "char_start", "char_end", content_hash(F.col("_body")).alias("text_hash"), F.concat(F.lit("sec_"), identity).alias("section_id"))


def version(struct: str) -> Column:
    """sha256 over the version signals in their fixed order, absent ones as null."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"{struct}.{s}").alias(s) for s in SIGNALS]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def shared_signal(old: str, new: str) -> Column:
    """First signal that both versions have; null without one."""
    return F.coalesce(*[F.when(F.col(f"{old}.{s}").isNotNull() & F.col(f"{new}.{s}").isNotNull(), s) for s in SIGNALS])


def changed_signals(old: str, new: str) -> Column:
    """Signals that both have and that differ; path hashes are compared without case."""
    differs = lambda s: (F.lower(F.col(f"{old}.{s}")) != F.lower(F.col(f"{new}.{s}"))) if s == "path_hash" else (F.col(f"{old}.{s}") != F.col(f"{new}.{s}"))
    return F.filter(F.array(*[F.when(differs(s), s) for s in SIGNALS]), lambda s: s.isNotNull())


def check_updates(manifests: DataFrame, probes: DataFrame, profile: str, complete: bool, vault: DataFrame | None = None) -> DataFrame:
    """(source_id, state, action, changed): nine states from probes alone, contents are not fetched.

    manifests: source_id, availability, processing_profile, vault_object, version (struct).
    probes: source_id and the signals. Removed sources are reported for a complete inventory
    only. vault: (vault_id) of objects that are there.
    """
    m = manifests.select("source_id", F.struct("availability", "processing_profile", "vault_object", "version").alias("m"))
    if vault is not None:
        kept = vault.select(F.col("vault_id").alias("_v"), F.lit(True).alias("_there"))
        m = m.join(kept, F.col("m.vault_object") == F.col("_v"), "left").withColumn("_there", F.coalesce("_there", F.lit(False))).drop("_v")
    else:
        m = m.withColumn("_there", F.col("m.vault_object").isNotNull())
    rows = m.join(probes.select("source_id", F.struct(*SIGNALS).alias("p")), "source_id", "full")
    primary, changed = shared_signal("m.version", "p"), changed_signals("m.version", "p")
    state = (
        F.when(F.col("p").isNull(), F.when((F.col("m.availability") == "available") & F.lit(complete), "removed"))
        .when(F.col("m").isNull(), "new")
        .when(F.col("m.availability") == "missing", "restored")
        .when(~F.coalesce(F.col("m.processing_profile") == profile, F.lit(False)), "processing_profile_changed")
        .when(~F.col("_there"), "evidence_missing")
        .when(primary.isNull(), "update_unknown")
        .when(F.array_contains(changed, primary), F.when(primary == "path_hash", "content_changed").otherwise("update_unknown"))
        .when(F.size(changed) > 0, "metadata_only")
        .otherwise("unchanged")
    )
    found = rows.select("source_id", state.alias("state"), F.coalesce(changed, F.array().cast("array<string>")).alias("changed")).where("state is not null")
    return found.withColumn("action", action("state"))


def action(state: str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in ACTIONS.items():
        out = F.when(F.col(state) == k, v).otherwise(out)
    return out


def update_summary(states: DataFrame) -> DataFrame:
    """(state, n) with a row for every state."""
    every = states.sparkSession.createDataFrame([(s,) for s in ACTIONS], "state string")
    return every.join(states.groupBy("state").agg(F.count(F.lit(1)).alias("_n")), "state", "left").select("state", F.coalesce("_n", F.lit(0)).alias("n"))


def classify_fetched(rows: DataFrame) -> DataFrame:
    """Add `change` after a fetch: old and new (structs: availability, content_hash, fingerprint, processing_profile), either null."""
    o, n = lambda c: F.col(f"old.{c}"), lambda c: F.col(f"new.{c}")
    base = (
        F.when(F.col("old").isNull(), "new")
        .when((o("availability") == "available") & (F.col("new").isNull() | (n("availability") == "missing")), "removed")
        .when((o("availability") == "missing") & (n("availability") == "available"), "restored")
        .when(F.lower(o("content_hash")) != F.lower(n("content_hash")), "content_changed")
        .when(o("fingerprint") != n("fingerprint"), "metadata_only")
        .when(~o("processing_profile").eqNullSafe(n("processing_profile")), "metadata_only")
        .otherwise("unchanged")
    )
    return rows.withColumn("change", base).withColumn("review_reset", F.col("change").isin("content_changed", "restored"))


def ingest(manifests: DataFrame, fetched: DataFrame, complete: bool) -> DataFrame:
    """New manifests after a fetch: changed and new sources replace their rows, failures keep theirs.

    fetched: the manifest columns, and `error`. Sources that a complete inventory does not list
    become missing; of an incomplete one nothing is removed.
    """
    good = fetched.where("error is null")
    o, n = manifests.select("source_id", F.struct(*manifests.columns).alias("old")), good.select("source_id", F.struct(*manifests.columns).alias("new"))
    failed = fetched.where("error is not null").select("source_id").withColumn("_failed", F.lit(True))
    rows = o.join(n, "source_id", "full").join(failed, "source_id", "left")
    reset = F.lower(F.col("old.content_hash")) != F.lower(F.col("new.content_hash"))
    merged = F.when(F.col("new").isNotNull(), F.col("new")).when(F.col("_failed") | F.lit(not complete), F.col("old")).otherwise(F.col("old").withField("availability", F.lit("missing")))
    kept = F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.coalesce(reset, F.lit(False))
    merged = F.when(kept, merged.withField("processing_status", F.col("old.processing_status")).withField("processed_content_hash", F.col("old.processed_content_hash"))).otherwise(merged)
    return rows.select(merged.alias("m")).select("m.*")


def update_health(registrations: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a connector: unchecked, current or stale; totals). unchecked in the totals counts every connector that is not current."""
    keys = ["connector_id", "generation", "scope_fingerprint"]
    any_ = reports.select("connector_id").distinct().withColumn("_any", F.lit(True))
    rows = registrations.join(reports.withColumn("_r", F.lit(True)), keys, "left").join(any_, "connector_id", "left")
    state = F.when(F.col("_r") & (F.col("checked_at") >= F.coalesce("ingested_at", F.lit(""))), "current").when(F.col("_any"), "stale").otherwise("unchecked")
    each = rows.select("connector_id", state.alias("state"), F.when(state == "current", F.coalesce("updates_available", F.lit(0))).otherwise(0).alias("updates_available"), F.when(state == "current", F.coalesce("verification_required", F.lit(0))).otherwise(0).alias("verification_required"))
    totals = each.agg(F.count(F.lit(1)).alias("registered"), F.count_if(F.col("state") != "current").alias("unchecked"), F.count_if(F.col("state") == "stale").alias("stale"), F.coalesce(F.sum("updates_available"), F.lit(0)).alias("updates_available"), F.coalesce(F.sum("verification_required"), F.lit(0)).alias("verification_required"))
    return each, totals


def register(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert connector registrations (connector_id, scope_fingerprint, generation): another scope starts a new generation."""
    rows = old.select("connector_id", F.struct(*old.columns).alias("o")).join(new.select("connector_id", F.struct(*new.columns).alias("n")), "connector_id", "full")
    generation = F.when(F.col("o").isNull(), 1).when(F.col("o.scope_fingerprint") != F.col("n.scope_fingerprint"), F.col("o.generation") + 1).otherwise(F.col("o.generation"))
    return rows.select("connector_id", F.coalesce("n.scope_fingerprint", "o.scope_fingerprint").alias("scope_fingerprint"), generation.cast("long").alias("generation"))


def review_state() -> Column:
    """missing, pending, current or stale, from a manifest's own columns."""
    pending = F.col("processing_status") == "pending"
    return F.when((F.col("availability") == "missing") & pending, "missing").when(pending, "pending").when(F.col("processed_content_hash") == F.col("content_hash"), "current").otherwise("stale")


def list_sources(manifests: DataFrame, status: str | None = None, availability: str | None = None, project: str | None = None, needs_review: bool = False) -> DataFrame:
    rows = manifests.withColumn("review_state", review_state())
    for value, column in ((status, "processing_status"), (availability, "availability")):
        if value:
            rows = rows.where(F.col(column) == value)
    if project:
        rows = rows.where(F.array_contains("project_keys", project))
    if needs_review:
        rows = rows.where(F.col("review_state") != "current")
    return rows.orderBy("source_id")


def mark_reviewed(manifests: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests, refused receipts): a receipt counts if it names the hash that is there now (optimistic lock).

    receipts: source_id, expected_hash, status, duplicate_of, refined_knowledge_ids. Of several
    receipts of a source that name one hash, the one whose JSON is largest counts; the others
    are neither applied nor refused. A manifest stays one row.
    """
    body = F.struct(*[c for c in receipts.columns if c != "source_id"])
    r = receipts.groupBy("source_id", F.col("expected_hash").alias("_hash")).agg(F.max_by(body, F.to_json(body)).alias("r"))
    rows = manifests.join(r, (r.source_id == manifests.source_id) & (r._hash == manifests.content_hash), "left").drop(r.source_id)
    ok = F.col("r").isNotNull()
    changed = {"processing_status": F.col("r.status"), "processed_content_hash": F.col("content_hash"), "duplicate_of": F.col("r.duplicate_of"), "refined_knowledge_ids": F.col("r.refined_knowledge_ids")}
    out = rows.select(*[F.when(ok, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in manifests.columns])
    there = manifests.groupBy("source_id").agg(F.max("content_hash").alias("_h"))
    refused = receipts.join(there, "source_id", "left").where(F.col("_h").isNull() | (F.col("_h") != F.col("expected_hash"))).drop("_h")
    return out, refused


def newest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row of each key; of several of one time, the one whose JSON is largest."""
    row = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(time, F.to_json(row))).alias("_row")).select("_row.*")
