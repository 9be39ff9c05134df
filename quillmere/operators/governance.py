"""Candidates, catalogues, captured material, maintenance proposals, vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.redaction import has_secret
from quillmere.functions.text import content_hash, short_hash, slug

#: Least body of a candidate and of audited knowledge.
CANDIDATE_BODY, AUDIT_BODY = 300, 600


def candidate_status() -> Column:
    """active or proposed, from a candidate's own columns; the first test that holds decides."""
    thin = (F.col("layer") == "knowledge") & (F.col("kind") != "profile") & (F.length(F.trim("body")) < CANDIDATE_BODY)
    untrusted = (F.col("capture_mode") == "automated_session") | (F.col("actor_type") == "customer")
    return (
        F.when(thin | untrusted, "proposed")
        .when(F.col("source_authority") == "user_confirmed", "active")
        .when((F.col("source_authority") == "documented") & (F.col("actor_type") == "owner") & (F.col("capture_mode") == "direct_material") & (F.col("confidence") >= 0.8), "active")
        .when((F.col("source_authority") == "verified_task") & (F.col("kind") == "procedural") & (F.col("confidence") >= 0.75), "active")
        .otherwise("proposed")
    )


def normalise_candidates(df: DataFrame) -> DataFrame:
    """Plain names to weighted ones: the first of a list 0.8, the others 0.5; a status; secrets fail."""
    weight = lambda i: F.when(i == 0, 0.8).otherwise(0.5)
    rows = df.withColumn("aliases", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a, i: F.struct(a.alias("value"), F.lit("term").alias("kind"), weight(i).alias("weight"), F.lit("candidate").alias("source"))))
    rows = rows.withColumn("scenarios", F.transform(F.coalesce("scenarios", F.array().cast("array<string>")), lambda s, i: F.struct(s.alias("id"), F.when(i == 0, "primary").otherwise("secondary").alias("role"), weight(i).alias("weight"))))
    rows = rows.withColumn("tags", F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t, i: F.struct(t.alias("value"), weight(i).alias("weight"), F.lit("candidate").alias("source"), F.lit(True).alias("retrieval"))))
    whole = F.to_json(F.struct(*rows.columns))
    clean = F.when(has_secret(whole), F.raise_error(F.concat(F.lit("secret in candidate "), F.coalesce("id", F.lit("null")))).cast("boolean")).otherwise(True)
    return rows.where(clean).withColumn("status", candidate_status())


def write_candidates(inbox: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inbox, conflicts): an id with the same content is written once, one with other content is a conflict."""
    h = lambda df: df.withColumn("_h", content_hash(F.to_json(F.struct(*sorted(c for c in df.columns if c not in ("created_at", "updated_at"))))))
    old, fresh = h(inbox), h(new)
    known = old.select("id", F.col("_h").alias("_o"))
    rows = fresh.dropDuplicates(["id", "_h"]).join(known, "id", "left")
    return inbox.unionByName(rows.where("_o is null").select(*inbox.columns)), rows.where("_o is not null and _o <> _h").select(*new.columns)


def unique_paths(df: DataFrame, folder: Column, title: Column) -> DataFrame:
    """Add `path`: folder / slug of the title; of several rows with one path all but the first (by id) get a number."""
    rows = df.withColumn("_p", F.concat_ws("/", folder, slug(title)))
    n = F.row_number().over(Window.partitionBy("_p").orderBy("id"))
    return rows.withColumn("_n", n).withColumn("path", F.concat(F.col("_p"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""), F.lit(".md"))).drop("_p", "_n")


def organise_inbox(inbox: DataFrame, approved: list[str]) -> DataFrame:
    """Approved proposals become active; an approved id that is not there fails before anything is written."""
    missing = set(approved) - {r[0] for r in inbox.where(F.col("id").isin(*approved)).select("id").distinct().collect()} if approved else set()
    if missing:
        raise ValueError(f"not in the inbox: {', '.join(sorted(missing))}")
    blocked = F.when(F.col("actor_type") == "customer", "customer material").when(F.col("capture_mode") == "automated_session", "automated session")
    ok = F.col("id").isin(*approved) if approved else F.lit(False)
    return inbox.withColumn("blocked", blocked).withColumn("action", F.when(ok & F.col("blocked").isNull(), "promote").when(ok, "blocked").otherwise("keep")).withColumn("status", F.when(F.col("action") == "promote", "active").otherwise(F.col("status")))


def supersede(knowledge: DataFrame) -> DataFrame:
    """Active documents that an active document supersedes become deprecated."""
    gone = knowledge.where("status = 'active'").select(F.explode("supersedes").alias("id")).distinct().withColumn("_gone", F.lit(True))
    return knowledge.join(gone, "id", "left").withColumn("status", F.when((F.col("status") == "active") & F.col("_gone"), "deprecated").otherwise(F.col("status"))).drop("_gone")


def capture(known: DataFrame, material: DataFrame) -> DataFrame:
    """What each piece of material (source, text) does: duplicate (text is there), replace (source is there), new."""
    h = material.withColumn("hash", content_hash(F.col("text")))
    by_hash, by_source = known.select("hash").distinct().withColumn("_h", F.lit(True)), known.select("source").distinct().withColumn("_s", F.lit(True))
    return h.join(by_hash, "hash", "left").join(by_source, "source", "left").select("source", "hash", F.when(F.col("_h"), "duplicate").when(F.col("_s"), "replace").otherwise("new").alias("action"))


def catalogue(knowledge: DataFrame) -> DataFrame:
    """(dimension, value, n): documents by status, kind and domain; scenarios and aliases, repeats within one counted."""
    one = lambda c: knowledge.select(F.lit(c).alias("dimension"), F.col(c).alias("value"))
    many = lambda c, f: knowledge.select(F.lit(c).alias("dimension"), F.explode(F.transform(c, lambda x: x[f])).alias("value"))
    rows = one("status").unionByName(one("kind")).unionByName(one("domain")).unionByName(many("scenarios", "id")).unionByName(many("aliases", "value"))
    return rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def catalogue_items(knowledge: DataFrame) -> DataFrame:
    return knowledge.select("id", "title", "kind", "layer", "status", "domain", F.transform("scenarios", lambda s: s["id"]).alias("scenarios"), F.transform("aliases", lambda a: a["value"]).alias("aliases"), F.col("synopsis").alias("summary"), "confidence", "file_path").orderBy("id")


def registry(knowledge: DataFrame) -> DataFrame:
    """(dimension, keys): the different domains and scenarios, sorted."""
    rows = knowledge.select(F.lit("domains").alias("dimension"), F.col("domain").alias("v")).unionByName(knowledge.select(F.lit("scenarios").alias("dimension"), F.explode(F.transform("scenarios", lambda s: s["id"])).alias("v")))
    return rows.groupBy("dimension").agg(F.array_sort(F.collect_set("v")).alias("keys"))


def catalogue_markdown(knowledge: DataFrame) -> DataFrame:
    """(domain, markdown): one block a domain, its documents by id."""
    line = F.concat(F.lit("- `"), "id", F.lit("` **"), "title", F.lit("** ("), "kind", F.lit(", "), "status", F.lit("): "), "synopsis")
    return knowledge.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("_l")).select("domain", F.concat(F.lit("## "), "domain", F.lit("\n\n"), "_l", F.lit("\n")).alias("markdown")).orderBy("domain")


def _plain(c: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))


def match_observations(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Observations with the first active document (by id) of their domain whose title or an alias is theirs."""
    names = catalog.where("status = 'active'").select("id", F.col("summary").alias("_summary"), _plain("domain").alias("_d"), F.explode(F.array_union(F.array("title"), "aliases")).alias("_name")).withColumn("_t", _plain("_name"))
    first = names.groupBy("_d", "_t").agg(F.min(F.struct("id", "_summary")).alias("_m"))
    rows = observations.withColumn("_d", _plain("domain")).withColumn("_t", _plain("title"))
    return rows.join(first, ["_d", "_t"], "left").withColumn("target", F.col("_m.id")).withColumn("target_summary", F.col("_m._summary")).drop("_d", "_t", "_m")


def propose_maintenance(matched: DataFrame) -> DataFrame:
    """One proposal an observation: update above conflict above duplicate above consolidation."""
    a, b = _plain("summary"), _plain("target_summary")
    same = F.col("target").isNotNull() & (F.contains(a, b) | F.contains(b, a))
    kind = F.when(F.col("supersedes").isNotNull(), "update").when(F.col("conflicts_with").isNotNull(), "conflict").when(same, "duplicate").otherwise("consolidation")
    targets = F.filter(F.array(F.coalesce("supersedes", "conflicts_with", "target")), lambda x: x.isNotNull())
    return matched.select(short_hash("", 20, kind, F.col("domain"), F.col("id"), F.array_join(targets, ",")).alias("proposal_id"), kind.alias("type"), F.lit("pending").alias("status"), "domain", "title", F.array("id").alias("observation_ids"), targets.alias("target_ids"), F.col("summary").alias("proposed_summary"))


def propose_skills(observations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Procedures (domain, title, summary) seen in three sessions, all trusted, without a conflict, with feedback to match.

    observations: those of match_observations() over all history, with session_hash,
    source_authority, useful_feedback. feedback (memory_id, net) counts once for a document
    however many observations name it.
    """
    rows = observations.where("kind = 'procedural'").join(feedback.select(F.col("memory_id").alias("target"), "net"), "target", "left")
    keys = [_plain(c).alias(f"_{c}") for c in ("domain", "title", "summary")]
    own = rows.select("*", *keys)
    group = ["_domain", "_title", "_summary"]
    trusted = F.col("source_authority").isin("verified_task", "user_confirmed")
    sums = own.groupBy(*group).agg(F.count_distinct("session_hash").alias("sessions"), F.min(trusted).alias("trusted"), F.max(F.col("conflicts_with").isNotNull()).alias("conflict"), F.coalesce(F.sum(F.when(F.col("net").isNull(), F.coalesce("useful_feedback", F.lit(0)))), F.lit(0)).alias("imported"), F.array_sort(F.collect_set("id")).alias("observation_ids"), F.min_by("domain", "id").alias("domain"), F.min_by("title", "id").alias("title"), F.min_by("summary", "id").alias("proposed_summary"))
    net = own.where("net is not null").select(*group, "target", "net").distinct().groupBy(*group).agg(F.sum("net").alias("logged"))
    ok = sums.join(net, group, "left").where((F.col("sessions") >= 3) & F.col("trusted") & ~F.col("conflict") & (F.col("imported") + F.coalesce("logged", F.lit(0)) >= F.col("sessions")))
    return ok.select(short_hash("", 20, F.lit("skill"), F.col("domain"), F.array_join("observation_ids", ",")).alias("proposal_id"), F.lit("skill").alias("type"), F.lit("pending").alias("status"), "domain", "title", "observation_ids", F.array().cast("array<string>").alias("target_ids"), "proposed_summary")


def observations_from_stops(logs: DataFrame) -> DataFrame:
    """Observations from stop records (payload JSON): the first field that is there of several names."""
    pick = lambda *names: F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names])
    rows = logs.where("event = 'stop'").select(pick("observation.title", "title", "task").alias("title"), pick("observation.summary", "summary", "result", "last_message").alias("summary"), pick("observation.domain", "domain").alias("domain"), pick("observation.kind", "kind").alias("kind"), F.substring(F.sha2(F.coalesce("session_id", F.lit("")).cast("binary"), 256), 1, 16).alias("session_hash"), "timestamp")
    return rows.where("title is not null and summary is not null").withColumn("id", short_hash("obs_", 20, F.col("title"), F.col("summary"), F.coalesce("domain", F.lit("")), F.col("session_hash")))


def decide_proposals(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (proposal_id, accepted); only pending proposals change."""
    rows = proposals.join(decisions.groupBy("proposal_id").agg(F.max("accepted").alias("_a")), "proposal_id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "pending") & F.col("_a").isNotNull(), F.when(F.col("_a"), "accepted").otherwise("rejected")).otherwise(F.col("status"))).drop("_a")


# --------------------------------------------------------------------------- vault


def vault_id(content: Column) -> Column:
    return F.concat(F.lit("vault_sha256_"), F.sha2(content, 256))


def vault_put(vault: DataFrame, tombstones: DataFrame, content: DataFrame, key: str, key_id: str) -> DataFrame:
    """The vault with `content` (content binary) sealed by AES-256-GCM, each different content once.

    The key (32 characters) is a literal of the plan: pass it from the driver's environment and
    keep plans out of logs. The id of the object is its additional data. A tombstoned id, or one
    that is held under another key, fails.
    """
    rows = content.select("content", vault_id(F.col("content")).alias("vault_id")).dropDuplicates(["vault_id"])
    gone = tombstones.select("vault_id", F.lit(True).alias("_t"))
    held = vault.select("vault_id", F.col("key_id").alias("_k"))
    rows = rows.join(gone, "vault_id", "left").join(held, "vault_id", "left")
    ok = F.when(F.col("_t"), F.raise_error(F.concat(F.lit("deleted for good: "), "vault_id")).cast("boolean")).when(F.col("_k") != key_id, F.raise_error(F.concat(F.lit("held under another key: "), "vault_id")).cast("boolean")).otherwise(True)
    new = rows.where(ok).where("_k is null").select("vault_id", F.lit(key_id).alias("key_id"), F.length("content").cast("long").alias("bytes"), F.aes_encrypt("content", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col("vault_id")).alias("sealed"))
    return vault.unionByName(new)


def vault_get(vault: DataFrame, ids: DataFrame, key: str, key_id: str) -> DataFrame:
    """(vault_id, content) of wanted ids; another key, a broken seal, hash or length fails."""
    rows = vault.join(ids.select("vault_id").distinct(), "vault_id").withColumn("content", F.aes_decrypt("sealed", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.col("vault_id")))
    ok = F.when(F.col("key_id") != key_id, F.raise_error(F.lit("another key")).cast("boolean")).when((vault_id(F.col("content")) != F.col("vault_id")) | (F.length("content") != F.col("bytes")), F.raise_error(F.lit("content differs from its id")).cast("boolean")).otherwise(True)
    return rows.where(ok).select("vault_id", "content")


def vault_delete(vault: DataFrame, tombstones: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = vault.join(ids, "vault_id", "left_semi").select("vault_id")
    return vault.join(ids, "vault_id", "left_anti"), tombstones.unionByName(gone).distinct()


def vault_status(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


# --------------------------------------------------------------------------- outbox


def enqueue(outbox: DataFrame, notices: DataFrame) -> DataFrame:
    """Notices with a key that is not there yet; of equal keys the first by time."""
    first = notices.groupBy("key").agg(F.min(F.struct("created_at", "body")).alias("_f")).select("key", F.col("_f.created_at").alias("created_at"), F.col("_f.body").alias("body"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.col("_f.created_at").alias("next_at"))
    return outbox.unionByName(first.join(outbox.select("key"), "key", "left_anti").select(*outbox.columns))


def record_delivery(outbox: DataFrame, tries: DataFrame, base: float = 60.0, most: float = 3600.0, limit: int = 8) -> DataFrame:
    """tries (key, ok, at): delivered, failed for good after `limit`, or due again after base * 2^(n - 1) seconds, at most `most`."""
    rows = outbox.join(tries, "key", "left")
    n = F.col("attempts") + 1
    wait = F.least(F.lit(most), base * F.pow(F.lit(2.0), n - 1))
    due = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.col("at").cast("timestamp")) + wait), "yyyy-MM-dd HH:mm:ss")
    return rows.select("key", "created_at", "body", F.when(F.col("ok"), "delivered").when(F.col("ok").isNotNull() & (n >= limit), "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("ok").isNotNull(), n).otherwise(F.col("attempts")).alias("attempts"), F.when(~F.col("ok"), due).otherwise(F.col("next_at")).alias("next_at"))
