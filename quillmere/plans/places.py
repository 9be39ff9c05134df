"""Queries over sessions, media, links, ingestion runs, synchronised stores, audits and views of the graph, each through its operator."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import audit, graph, ingestion_run, markup, sync_run
from quillmere.plans import heart
from quillmere.plans.governed import GRAPH_BUILD
from quillmere.plans.search import table
from quillmere.sources import connectors, store, transcripts
from quillmere.storage import settle, shared_dir


def _named(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def _place(spark: SparkSession, name: str) -> str:
    """A new folder among those of the application, which go when it ends."""
    return f"{shared_dir(spark)}/quillmere/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- sessions


def transcript_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON-lines logs of twenty sessions each, their turns interleaved; sessions put together from parent links."""
    c = table(spark, sf_dir, "conversations")
    key = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    record = F.to_json(F.struct(_named("s", F.col("conv_id")).alias("sessionId"), key(F.col("turn")).alias("uuid"), key(F.col("turn") - 1).alias("parentUuid"), "role", F.lpad(F.col("turn").cast("string"), 9, "0").alias("timestamp"), "text"))
    lines = c.select(F.floor(F.col("conv_id") / 20).alias("file"), F.struct("turn", "conv_id", record.alias("line")).alias("r"))
    logs = lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("text"))  # twenty conversations a file
    return transcripts.sessions(logs.select(_named("f", F.col("file")).alias("source_id"), "text")).select("source_id", "session", F.col("place").cast("long").alias("place"), "id", "depth", "role", F.length("text").cast("long").alias("chars"))


TRANSCRIPT_SESSIONS = """
WITH c AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY turn, conv_id) AS line FROM conversations),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS depth, min(line) OVER (PARTITION BY conv_id, run) AS first FROM c)
SELECT 'f' || (conv_id // 20) AS source_id, 's' || conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY first, depth) AS place, conv_id || ':' || turn AS id, depth, role, length(coalesce(text, '')) AS chars FROM d
"""


# --------------------------------------------------------------------------- media and links


def media_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, blocks and the language mark of pages in order, and how often each handle came before."""
    return markup.media(table(spark, sf_dir, "pages"), {"a": "href", "div": "class", "html": "lang"}, "page_id", "html").select(F.col("key").alias("page_id"), "ordinal", "element", "handle", "occurrence")


MEDIA_ORDINALS = r"""
WITH t AS (SELECT page_id, unnest(x) AS tag, unnest(range(len(x))) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:a|div|html)\b[^>]*>') AS x FROM pages)),
h AS (SELECT page_id, CAST(n AS INTEGER) AS ordinal, regexp_extract(tag, '^<(\w+)', 1) AS element,
        CASE WHEN regexp_matches(tag, '[\s"](?:' || CASE regexp_extract(tag, '^<(\w+)', 1) WHEN 'a' THEN 'href' WHEN 'div' THEN 'class' ELSE 'lang' END || ')\s*=\s*"[^"]*"') THEN regexp_extract(tag, '[\s"](?:' || CASE regexp_extract(tag, '^<(\w+)', 1) WHEN 'a' THEN 'href' WHEN 'div' THEN 'class' ELSE 'lang' END || ')\s*=\s*"([^"]*)"', 1) END AS handle FROM t)
SELECT page_id, ordinal, element, handle, CASE WHEN handle IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY page_id, handle ORDER BY ordinal) AS INTEGER) END AS occurrence FROM h
"""


def _asset(n: Column) -> Column:
    return F.concat(F.lit("asset_sha256_"), F.sha2(n.cast("string"), 256))


def asset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to assets resolved in documents with fenced examples, of which a fifth names an asset that isn't there."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    uri = lambda n: F.concat(F.lit("](asset://"), _asset(n), F.lit(")"))
    text = F.translate(F.coalesce("text", F.lit("")), "`~", "")
    body = F.concat(F.lit("[a"), uri(F.col("doc_id")), F.lit("\n"), text, F.lit("\n```\n[b"), uri(F.col("doc_id")), F.lit(" asset://\n~~~\n```\n![c"), uri(F.col("doc_id") + 1))
    docs = d.select(F.concat(F.lit("knowledge/"), F.coalesce("lang", F.lit("x")), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("body"))
    ids = d.select("doc_id").unionByName(d.select((F.col("doc_id") + 1).alias("doc_id"))).distinct().where("doc_id % 5 <> 0")
    asset = _asset(F.col("doc_id"))
    assets = ids.select(asset.alias("asset_id"), F.concat(F.lit(markup.OBJECTS), F.substring(asset, 14, 2), F.lit("/"), asset, F.lit(".png")).alias("relative_path"))
    return markup.resolve_assets(docs, assets).select("path", F.sha2("body", 256).alias("body_sha256"), "error")


ASSET_LINKS = """
WITH d AS (SELECT doc_id, coalesce(lang, 'x') AS lang, translate(coalesce(text, ''), '`~', '') AS t, sha256(CAST(doc_id AS VARCHAR)) AS a, sha256(CAST(doc_id + 1 AS VARCHAR)) AS c FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT *, '](../assets/objects/' || a[1:2] || '/asset_sha256_' || a || '.png)' AS la, '](../assets/objects/' || c[1:2] || '/asset_sha256_' || c || '.png)' AS lc FROM d)
SELECT 'knowledge/' || lang || '/d' || doc_id || '.md' AS path, CASE WHEN doc_id % 5 <> 0 AND (doc_id + 1) % 5 <> 0 THEN sha256('[a' || la || chr(10) || t || chr(10) || '```' || chr(10) || '[b](asset://asset_sha256_' || a || ') asset://' || chr(10) || '~~~' || chr(10) || '```' || chr(10) || '![c' || lc) END AS body_sha256,
       CASE WHEN doc_id % 5 = 0 THEN 'no asset asset_sha256_' || a WHEN (doc_id + 1) % 5 = 0 THEN 'no asset asset_sha256_' || c END AS error FROM l
"""


# --------------------------------------------------------------------------- ingestion and synchronisation


def connector_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages taken in twice, some changed and some gone the second time: their manifests then, and the second run's counters."""
    p, path = table(spark, sf_dir, "pages"), _place(spark, "ingest")
    rows = p.select(_named("p", F.col("page_id")).alias("external_key"), F.col("html").alias("content"), F.lit("t1").alias("updated_at"), "page_id")
    ingestion_run.run(spark, connectors.Table("pages", rows.drop("page_id")), path, connectors.SECRETS)
    grown = F.when(F.col("page_id") % 7 == 0, F.concat("content", F.lit("<h2>More</h2>tail"))).otherwise(F.col("content"))
    later = rows.where("page_id % 11 <> 0").withColumn("content", grown).withColumn("updated_at", F.when(F.col("page_id") % 5 == 0, "t2").otherwise("t1"))
    done = ingestion_run.run(spark, connectors.Table("pages", later.drop("page_id")), path, connectors.SECRETS)
    each = done.manifests.join(done.jobs.select("source_id", "state", "status"), "source_id", "left").select("external_key", "availability", "content_hash", "state", "status")
    none = F.lit(None).cast("string")
    counted = spark.createDataFrame([(k, str(v)) for k, v in done.counters.items() if k != "redacted"], "external_key string, state string")
    return each.unionByName(counted.select(F.concat(F.lit("#"), "external_key").alias("external_key"), none.alias("availability"), none.alias("content_hash"), "state", none.alias("status")))


CONNECTOR_INGEST = """
WITH p AS (SELECT page_id AS i, CASE WHEN page_id % 7 = 0 AND page_id % 11 <> 0 THEN html || '<h2>More</h2>tail' ELSE html END AS c, page_id % 11 = 0 AS gone FROM pages),
s AS (SELECT *, CASE WHEN gone THEN NULL WHEN i % 7 = 0 THEN 'content_changed' WHEN i % 5 = 0 THEN 'metadata_only' ELSE 'unchanged' END AS state FROM p)
SELECT 'p' || i AS external_key, CASE WHEN gone THEN 'missing' ELSE 'available' END AS availability, sha256(c) AS content_hash, state, CASE state WHEN 'unchanged' THEN 'skipped' WHEN NULL THEN NULL ELSE CASE WHEN gone THEN NULL ELSE 'completed' END END AS status FROM s
UNION ALL SELECT '#discovered', NULL, NULL, CAST(count(*) AS VARCHAR), NULL FROM s WHERE NOT gone
UNION ALL SELECT '#skipped', NULL, NULL, CAST(count(*) AS VARCHAR), NULL FROM s WHERE state = 'unchanged'
UNION ALL SELECT '#fetched', NULL, NULL, CAST(count(*) AS VARCHAR), NULL FROM s WHERE state <> 'unchanged'
UNION ALL SELECT '#failed', NULL, NULL, '0', NULL
UNION ALL SELECT '#bytes', NULL, NULL, CAST(coalesce(sum(octet_length(encode(c))) FILTER (state <> 'unchanged'), 0) AS VARCHAR), NULL FROM s
"""


def sync_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents brought together with a store that holds other versions of some: what was done, and the store's entries then."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(F.lit("knowledge/d"), i.cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    local = d.where("doc_id % 9 <> 0").select("path", "content", F.when(i % 5 == 4, "private").otherwise("team").alias("visibility"), F.lit("internal").alias("sensitivity"))
    there = F.when(i % 6 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    remote = d.where("doc_id % 3 <> 0").select("path", F.sha2(there, 256).alias("hash"), F.lit(False).alias("deleted"), F.when(i % 10 == 7, "private").otherwise("team").alias("visibility"), F.lit("internal").alias("sensitivity"), there.alias("content"))
    before = F.when(i % 8 == 2, F.concat("content", F.lit("?"))).otherwise(F.col("content"))
    base = d.where("doc_id % 4 <> 1").select("path", F.sha2(before, 256).alias("hash"), F.lit(False).alias("deleted"))
    backend = sync_run.StoreBackend(_place(spark, "remote"))
    backend.commit(remote, 0, None)
    done = sync_run.run(local, settle(base, "base"), backend)
    entries = backend.entries(spark).select("path", F.col("hash").alias("remote_hash"), F.col("deleted").alias("remote_deleted"))
    return done.done.join(entries, "path", "full").select("path", "action", "remote_hash", "remote_deleted")


SYNC_STORE = """
WITH d AS (SELECT doc_id AS i, 'knowledge/d' || doc_id || '.md' AS path, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
h AS (SELECT *, i % 5 = 4 AND i % 9 <> 0 AS held, CASE WHEN i % 9 <> 0 AND i % 5 <> 4 THEN sha256(t) END AS l, CASE WHEN i % 3 <> 0 THEN sha256(CASE WHEN i % 6 = 1 THEN t || '!' ELSE t END) END AS r, CASE WHEN i % 4 <> 1 THEN sha256(CASE WHEN i % 8 = 2 THEN t || '?' ELSE t END) END AS b, i % 3 <> 0 AND i % 10 = 7 AS barred FROM d),
a AS (SELECT *, CASE WHEN held THEN NULL WHEN barred THEN 'skip'
    WHEN b IS NULL THEN CASE WHEN l = r THEN 'record' WHEN l IS NOT NULL AND r IS NULL THEN 'push' WHEN l IS NULL AND r IS NOT NULL THEN 'pull' WHEN l IS NOT NULL THEN 'conflict' ELSE 'record' END
    WHEN l IS NOT DISTINCT FROM r THEN 'record'
    WHEN l IS DISTINCT FROM b AND r IS DISTINCT FROM b THEN 'conflict'
    WHEN l IS DISTINCT FROM b THEN CASE WHEN l IS NULL THEN 'delete_remote' ELSE 'push' END
    ELSE CASE WHEN r IS NULL THEN 'delete_local' ELSE 'pull' END END AS action FROM h),
o AS (SELECT path, CASE WHEN action <> 'record' THEN action END AS action, CASE WHEN action = 'push' THEN l ELSE r END AS remote_hash, CASE WHEN action = 'delete_remote' THEN TRUE WHEN action = 'push' OR r IS NOT NULL THEN FALSE END AS remote_deleted FROM a)
SELECT * FROM o WHERE action IS NOT NULL OR remote_hash IS NOT NULL
"""


# --------------------------------------------------------------------------- audits


def _audited(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Knowledge of parts, sources of customers, connectors of suppliers and nations, with faults of every kind."""
    p, k = F.col("p_partkey"), F.col("c_custkey")
    many = lambda n, kind: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: F.lit("x"))).otherwise(F.array().cast("array<string>"))  # noqa: E731, ARG005
    anchor = F.struct(_named("s", p % 100 + 1).alias("source_id"), _named("sec", p % 100 + 1).alias("section_id"), F.when(p % 4 != 0, _named("q", p % 100 + 1)).otherwise("stale").alias("quote_hash"))
    claim = lambda name, evidence: F.struct(F.lit(name).alias("id"), F.lit("supported").alias("status"), evidence.alias("evidence"))
    bare = F.filter(F.array(anchor), lambda a: F.lit(False))  # noqa: ARG005
    knowledge = table(spark, sf_dir, "part").select(
        _named("k", p).alias("id"), _named("f", p).alias("file_path"), F.when(p % 10 == 3, "deprecated").otherwise("active").alias("status"), F.when(p % 6 == 2, "synopsis").otherwise("knowledge").alias("layer"), F.when(p % 9 == 0, "profile").otherwise("semantic").alias("kind"),
        F.repeat(F.lit("x"), F.col("p_size") * 20).alias("body"), (F.col("p_size") * 20 + F.when(p % 23 == 0, 100_000).otherwise(50)).alias("raw_length"), many((p % 11).cast("int"), "a").alias("aliases"), many((p % 8).cast("int"), "s").alias("scenarios"), many((p % 10).cast("int"), "t").alias("tags"),
        F.array(_named("p", p % 5)).alias("project_keys"), F.array(_named("source:s", p % 400 + 1), F.lit("note")).alias("source"), F.when(p % 5 == 0, F.array(claim("c", F.array(anchor)), claim("d", bare))).otherwise(F.array(claim("c", F.array(anchor)))).alias("claims"),
    )
    none = F.lit(None).cast("string")
    version = F.struct(F.when(k % 17 != 0, _named("h", k)).alias("path_hash"), none.alias("commit_sha"), none.alias("revision"), none.alias("etag"), none.alias("opaque_version"), none.alias("updated_at"))
    manifests = table(spark, sf_dir, "customer").select(
        _named("s", k).alias("source_id"), F.col("c_name").alias("title"), F.when(k % 11 == 0, "missing").otherwise("available").alias("availability"), F.when(k % 7 == 0, "pending").when(k % 7 == 1, "duplicate").otherwise("refined").alias("processing_status"), _named("h", k).alias("content_hash"),
        F.when(k % 5 == 0, "old").otherwise(_named("h", k)).alias("processed_content_hash"), F.array(_named("k", k % 120 + 1)).alias("refined_knowledge_ids"), _named("s", k * 2).alias("duplicate_of"), F.when(k % 13 != 0, _named("v", k)).alias("vault_object"), version.alias("version"),
        F.when(k % 19 == 0, "not-applied").otherwise("secrets").alias("redaction_policy"), F.array(F.struct(_named("sec", k).alias("section_id"), _named("q", k).alias("text_hash"))).alias("sections"), F.array(_named("p", k % 4)).alias("project_keys"),
    )
    s, n, r = F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    failure = F.array(F.struct(_named("s", n).alias("source_id"), F.lit("no").alias("error")))
    return {
        "knowledge": knowledge, "manifests": manifests, "projects": table(spark, sf_dir, "region").where("r_regionkey < 3").select(_named("p", r).alias("project_key")),
        "vault": table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(_named("v", k).alias("vault_id")),
        "health": table(spark, sf_dir, "supplier").select(_named("c", s).alias("connector_id"), F.when(s % 4 == 0, "unchecked").when(s % 4 == 1, "stale").otherwise("current").alias("state"), (s % 3).alias("updates_available"), (s % 2).alias("verification_required")),
        "checkpoints": table(spark, sf_dir, "nation").select(_named("n", n).alias("connector_id"), F.when(n % 2 == 0, "complete").otherwise("partial").alias("mode"), (n % 3 != 0).alias("complete"), n.alias("unresolved"), F.when(n % 5 == 0, failure).otherwise(F.filter(failure, lambda f: F.lit(False))).alias("failures")),  # noqa: ARG005
        "streams": table(spark, sf_dir, "region").select(_named("r", r).alias("stream_id"), (r % 2 == 0).alias("valid"), r.cast("long").alias("first_bad")),
        "payloads_missing": table(spark, sf_dir, "region").where("r_regionkey > 2").select(_named("e", r).alias("event_id"), _named("o", r).alias("payload_object")),
    }


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every code over knowledge, sources, connectors and streams."""
    return audit.findings(**_audited(spark, sf_dir))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, coverages and medians of the audited knowledge and sources, in one row."""
    rows = _audited(spark, sf_dir)
    out = audit.summary(rows["knowledge"], rows["manifests"])
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_AUDITED = """
k AS (SELECT p_partkey AS p, 'k' || p_partkey AS id, p_partkey % 10 <> 3 AS active, p_partkey % 6 <> 2 AS deep, p_partkey % 9 <> 0 AS plain, p_size * 20 AS chars, p_size * 20 + CASE WHEN p_partkey % 23 = 0 THEN 100000 ELSE 50 END AS raw FROM part),
n AS (SELECT *, p % 100 + 1 AS src, p % 4 <> 0 AS fresh FROM k WHERE active AND deep),
m AS (SELECT c_custkey AS c, 's' || c_custkey AS id, c_name AS title, c_custkey % 11 <> 0 AS there, CASE WHEN c_custkey % 7 = 0 THEN 'pending' WHEN c_custkey % 7 = 1 THEN 'duplicate' ELSE 'refined' END AS st, c_custkey % 5 = 0 AS stale, CASE WHEN c_custkey % 13 <> 0 THEN 'v' || c_custkey END AS v FROM customer),
g AS (SELECT n.*, fresh AND coalesce(m.there, FALSE) AS grounded FROM n LEFT JOIN m ON m.c = n.src)"""
AUDIT_FINDINGS = f"""
WITH {_AUDITED},
f(code, subject, message) AS (
  SELECT 'knowledge_body_too_thin', id, chars || ' characters' FROM n WHERE plain AND chars < 600
  UNION ALL SELECT 'metadata_frontmatter_dominates', id, 'share ' || CAST(round((raw - chars) / raw, 3) AS VARCHAR) FROM n WHERE (raw - chars) / raw > 0.65
  UNION ALL SELECT 'too_many_aliases', id, (p % 11) || ' aliases' FROM n WHERE p % 11 > 8
  UNION ALL SELECT 'too_many_scenarios', id, (p % 8) || ' scenarios' FROM n WHERE p % 8 > 6
  UNION ALL SELECT 'too_many_tags', id, (p % 10) || ' tags' FROM n WHERE p % 10 > 8
  UNION ALL SELECT 'unknown_project_key', id, 'p' || (p % 5) FROM n WHERE p % 5 > 2
  UNION ALL SELECT 'unknown_project_key', id, 'p' || (c % 4) FROM m WHERE c % 4 > 2
  UNION ALL SELECT 'missing_source_manifest', id, 's' || (p % 400 + 1) FROM n WHERE 's' || (p % 400 + 1) NOT IN (SELECT id FROM m)
  UNION ALL SELECT 'unknown_evidence_anchor', id, 'c' FROM g WHERE NOT grounded
  UNION ALL SELECT 'source_missing_upstream', id, title FROM m WHERE NOT there
  UNION ALL SELECT 'source_without_refined_knowledge', id, title FROM m WHERE st = 'pending'
  UNION ALL SELECT 'source_review_stale', id, title FROM m WHERE st <> 'pending' AND stale
  UNION ALL SELECT 'invalid_refined_knowledge', id, 'k' || (c % 120 + 1) FROM m WHERE st = 'refined' AND NOT EXISTS (SELECT 1 FROM n WHERE n.p = c % 120 + 1 AND n.src = c AND fresh)
  UNION ALL SELECT 'invalid_duplicate_source', m.id, 's' || (m.c * 2) FROM m LEFT JOIN m t ON t.c = m.c * 2 WHERE m.st = 'duplicate' AND (t.c IS NULL OR NOT t.there OR t.st = 'duplicate')
  UNION ALL SELECT 'source_without_vault_object', id, title FROM m WHERE v IS NULL
  UNION ALL SELECT 'missing_vault_object', id, v FROM m WHERE v IS NOT NULL AND c % 3 = 0
  UNION ALL SELECT 'source_without_upstream_version', id, title FROM m WHERE c % 17 = 0
  UNION ALL SELECT 'source_redaction_not_recorded', id, title FROM m WHERE c % 19 = 0
  UNION ALL SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'source_connector_unchecked' ELSE 'source_update_check_stale' END, 'c' || s_suppkey, 'c' || s_suppkey FROM supplier WHERE s_suppkey % 4 < 2
  UNION ALL SELECT 'source_update_available', 'c' || s_suppkey, CAST(s_suppkey % 3 AS VARCHAR) FROM supplier WHERE s_suppkey % 4 > 1 AND s_suppkey % 3 > 0
  UNION ALL SELECT 'source_update_verification_required', 'c' || s_suppkey, '1' FROM supplier WHERE s_suppkey % 4 > 1 AND s_suppkey % 2 = 1
  UNION ALL SELECT 'source_inventory_incomplete', 'n' || n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 6 = 0
  UNION ALL SELECT 'source_ingestion_failed', 'n' || n_nationkey, 's' || n_nationkey || ' no' FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'event_timeline_invalid', 'r' || r_regionkey, CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey % 2 = 1
  UNION ALL SELECT 'event_payload_missing', 'e' || r_regionkey, 'o' || r_regionkey FROM region WHERE r_regionkey > 2)
SELECT CASE WHEN code IN ({", ".join(repr(c) for c in audit.ERRORS)}) THEN 'error' ELSE 'warning' END AS severity, code, subject, message FROM f
"""
AUDIT_REPORT = f"""
WITH {_AUDITED},
c AS (SELECT id, grounded FROM g UNION ALL SELECT id, TRUE FROM n WHERE p % 5 = 0)
SELECT (SELECT count(*) FROM m) AS source_documents, (SELECT count(*) FROM m WHERE st <> 'pending' AND NOT stale) AS classified_sources, round((SELECT avg(CASE WHEN st <> 'pending' AND NOT stale THEN 1.0 ELSE 0 END) FROM m), 9) AS source_coverage,
  round((SELECT avg(CASE WHEN there THEN 1.0 ELSE 0 END) FROM m), 9) AS availability_coverage, round((SELECT avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0 END) FROM m), 9) AS vault_coverage, (SELECT count(*) FROM k WHERE active AND deep) AS knowledge_documents, (SELECT count(*) FROM k WHERE active AND NOT deep) AS synopsis_documents,
  (SELECT median(chars)::DOUBLE FROM k WHERE active AND deep) AS median_body_chars, round((SELECT avg(CASE WHEN grounded THEN 1.0 ELSE 0 END) FROM c), 9) AS claim_coverage
"""


# --------------------------------------------------------------------------- graph


def _shown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("what"), "id", "type").unionByName(edges.select(F.lit("edge").alias("what"), "id", "type"))


def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two steps of a scenario and a project."""
    nodes, edges = graph.build(heart.knowledge(spark, sf_dir))
    return _shown(*graph.query(settle(nodes, "nodes"), settle(edges, "edges"), ids=["scenario:case-2", "project:p7"], depth=2))


def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document with what it touches, and the counts of kinds."""
    docs = heart.knowledge(spark, sf_dir)
    nodes, edges = graph.build(docs)
    shown, kept, counts = graph.view(settle(nodes, "nodes"), settle(edges, "edges"), docs.where("id like '%1'").select("id"))
    return _shown(shown, kept).unionByName(counts.select(F.lit("count").alias("what"), F.col("n").cast("string").alias("id"), "type"))


_GRAPH = GRAPH_BUILD[: GRAPH_BUILD.index("SELECT 'node' AS what")].strip().removeprefix("WITH ")
_NODES = f"{_GRAPH}, x AS (SELECT DISTINCT source, target, type, 'edge_' || sha256(source || chr(0) || target || chr(0) || type)[1:20] AS id FROM e), v AS (SELECT k AS id, 'knowledge' AS type FROM d UNION SELECT DISTINCT target, kind FROM e WHERE kind IS NOT NULL)"
GRAPH_QUERY = f"""
WITH {_NODES}, w AS (SELECT source AS here, target AS there FROM x UNION SELECT target, source FROM x),
r0 AS (SELECT id FROM v WHERE id IN ('scenario:case-2', 'project:p7')), r1 AS (SELECT id FROM r0 UNION SELECT there FROM w JOIN r0 ON here = id), r2 AS (SELECT id FROM r1 UNION SELECT there FROM w JOIN r1 ON here = id)
SELECT 'node' AS what, id, type FROM v WHERE id IN (FROM r2) UNION ALL SELECT 'edge', id, type FROM x WHERE source IN (FROM r2) AND target IN (FROM r2)
"""
GRAPH_VIEW = f"""
WITH {_NODES}, c AS (SELECT k AS id FROM d WHERE doc_id % 10 = 1), t AS (SELECT * FROM x WHERE source IN (FROM c) OR target IN (FROM c)), i AS (SELECT source AS id FROM t UNION SELECT target FROM t UNION SELECT id FROM c), s AS (SELECT * FROM v WHERE id IN (FROM i))
SELECT 'node' AS what, id, type FROM s UNION ALL SELECT 'edge', id, type FROM t WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s) UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR), type FROM s GROUP BY type
"""

_ALL = (transcript_sessions, media_ordinals, asset_links, connector_ingest, sync_store, audit_findings, audit_report, graph_query, graph_view)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
