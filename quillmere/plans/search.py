"""Retrieval queries: documents are the corpus, benchmark passages the requests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.functions import access, scores, text
from quillmere.operators import embeddings, packet
from quillmere.operators.index import Index, Substrings
from quillmere.operators.retrieval import dealt, dense_candidates, meet, packed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """The kept index of the documents' texts."""
    docs = table(spark, sf_dir, "documents")
    return Index.of_table(docs, "texts", {"body": F.col("text")}, "doc_id", evidence=F.lower("text"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.query_tokens(F.col("text"))).alias("phrase"))


def _hits(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """(query_id, id, relevance, score) of every passage's tokens against every document, or of its best ones."""
    return _index(spark, sf_dir).bm25(_asked(spark, sf_dir), most=most).withColumn("score", F.round("relevance", 6))


_HITS = r"""
dt AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE t <> ''),
dl AS (SELECT doc_id, count(t) AS len FROM dt GROUP BY doc_id),
al AS (SELECT d.doc_id, coalesce(len, 0) AS len FROM documents d LEFT JOIN dl USING (doc_id)),
st AS (SELECT count(*) AS n, avg(len) AS mean FROM al),
qt0 AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_/-]+'), lambda x: length(x) >= 2) AS l FROM benchmark),
qt AS (SELECT item_id, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 48)) AS raw FROM (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM qt0)),
qp AS (SELECT item_id, raw, strip_accents(raw) AS t FROM qt),
tf AS (SELECT doc_id, t, count(*) AS f FROM dt WHERE t IN (SELECT t FROM qp) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
hits AS (
  SELECT qp.item_id, tf.doc_id,
         round(sum(CASE WHEN ln((st.n - df.df + 0.5) / (df.df + 0.5)) <= 0 THEN 1e-6 ELSE ln((st.n - df.df + 0.5) / (df.df + 0.5)) END
                   * tf.f * 2.2 / (tf.f + 1.2 * (0.25 + 0.75 * dl.len / st.mean))), 6) AS score
  FROM qp JOIN tf USING (t) JOIN df USING (t) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY qp.item_id, tf.doc_id)
"""


def _ranked(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """_hits() with the place of every hit among its passage's."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return _hits(spark, sf_dir, most).withColumn("rank", F.row_number().over(order))


def bm25_topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The k best documents of each passage."""
    return _ranked(spark, sf_dir, k).where(F.col("rank") <= k).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


BM25_TOPK = f"WITH {_HITS} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 5"


def bm25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each passage: hits, and the sum of relevance relative to its best."""
    best = Window.partitionBy("query_id")
    rows = _hits(spark, sf_dir).withColumn("_r", F.col("score") / F.max("score").over(best))
    return rows.groupBy(F.col("query_id").alias("item_id")).agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum("_r"), 3).alias("mass"))


BM25_NORMALISED = f"WITH {_HITS} SELECT item_id, count(*) AS hits, round(sum(r), 3) AS mass FROM (SELECT item_id, score / max(score) OVER (PARTITION BY item_id) AS r FROM hits) GROUP BY item_id"


def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each passage, and those that hold at least two of its tokens as substrings."""
    index, asked, tokens = _index(spark, sf_dir), _asked(spark, sf_dir), text.query_tokens(F.col("text"))
    gate = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.size(tokens) <= 4).alias("free"), F.col("text").alias("task"), tokens.alias("tokens"))
    count = lambda rows, name: rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    both = count(index.bm25(asked), "hits").join(count(index.bm25(asked, gate=gate), "passed"), "query_id", "left")
    return both.select(F.col("query_id").alias("item_id"), "hits", F.coalesce("passed", F.lit(0)).alias("passed"))


EVIDENCE_GATE = f"""
WITH {_HITS},
ql AS (SELECT item_id, list(raw) AS l FROM qt GROUP BY item_id)
SELECT item_id, count(*) AS hits, count(*) FILTER (len(l) <= 4 OR len(list_filter(l, lambda x: contains(lower(d.text), x))) >= 2) AS passed
FROM hits JOIN ql USING (item_id) JOIN documents d USING (doc_id) GROUP BY item_id
"""


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", text.index_terms(F.col("text")).alias("_t"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("_t")).alias("tokens"), F.max(F.size("_t")).alias("longest"), F.sum(F.size(F.array_distinct("_t"))).alias("distinct_tokens"))


TOKEN_STATS = r"""
SELECT lang, count(*) AS docs, CAST(sum(len(l)) AS BIGINT) AS tokens, max(len(l)) AS longest, CAST(sum(len(list_distinct(l))) AS BIGINT) AS distinct_tokens
FROM (SELECT lang, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM documents) GROUP BY lang
"""


def dense_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The k rows of largest cosine for every row whose vec_id is divisible by 50, itself left out."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    found = dense_candidates(rows, asked, k + 1).where("query_id <> id")
    order = Window.partitionBy("query_id").orderBy(F.round("dense", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", F.round("dense", 6).alias("cosine"), "rank")


DENSE_TOPK = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.e, c.e) AS c FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, id, round(c, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS rank FROM s WHERE c > 0) WHERE rank <= 10
"""


def hybrid_rrf(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Lexical and dense ranks of each passage fused; row n of embeddings stands for passage and document n.

    Every lexical hit has its rank; of the dense channel the 20 best rows have one.
    """
    lexical = _ranked(spark, sf_dir).select("query_id", "id", F.col("rank").alias("lexical_rank"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).join(v, "id").select(F.col("id").alias("query_id"), "vector")
    corpus = v.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    dense = dense_candidates(corpus, asked, 20).select("query_id", "id", "dense_rank")
    both = lexical.join(dense, ["query_id", "id"], "full").withColumn("rrf", F.round(scores.reciprocal_ranks(F.col("lexical_rank"), F.col("dense_rank")), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rrf", "rank")


HYBRID_RRF = f"""
WITH {_HITS},
lex AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM hits),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
den0 AS (SELECT b.item_id, c.vec_id AS doc_id, list_cosine_similarity(q.e, c.e) AS c FROM benchmark b JOIN v q ON q.vec_id = b.item_id CROSS JOIN v c WHERE c.vec_id IN (SELECT doc_id FROM documents)),
den AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS r FROM den0 WHERE c > 0 QUALIFY r <= 20),
f AS (SELECT coalesce(lex.item_id, den.item_id) AS item_id, coalesce(lex.doc_id, den.doc_id) AS doc_id,
             round(least(1.0, (coalesce(1.0::DOUBLE / (60 + lex.r), 0.0) + coalesce(1.0::DOUBLE / (60 + den.r), 0.0)) / (3.0::DOUBLE / 61)), 6) AS rrf
      FROM lex FULL JOIN den ON lex.item_id = den.item_id AND lex.doc_id = den.doc_id)
SELECT item_id, doc_id, rrf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS rank FROM f) WHERE rank <= 5
"""


_NORM = "regexp_replace(regexp_replace(lower(trim({0})), '[_\\s]+', '-', 'g'), '-+', '-', 'g')"


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different part names that match as labels: equal or one below the other, or all segments of the shorter in the longer."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    seg = names.select("p_name", F.explode(text.label_segments(F.col("p_name"))).alias("_s"))
    pairs = seg.alias("a").join(seg.alias("b"), (F.col("a._s") == F.col("b._s")) & (F.col("a.p_name") < F.col("b.p_name"))).select(F.col("a.p_name").alias("left_name"), F.col("b.p_name").alias("right_name")).distinct()
    return pairs.select("left_name", "right_name", access.fuzzy_matches(F.col("left_name"), F.col("right_name")).alias("fuzzy"), access.domain_matches(F.col("left_name"), F.col("right_name")).alias("domain"))


LABEL_MATCH = f"""
WITH n AS (SELECT DISTINCT p_name, {_NORM.format("p_name")} AS v FROM part),
s AS (SELECT p_name, v, list_filter(regexp_split_to_array(v, '[/-]+'), lambda x: x <> '') AS s FROM n)
SELECT a.p_name AS left_name, b.p_name AS right_name,
       (a.v = b.v OR starts_with(a.v, b.v || '/') OR starts_with(b.v, a.v || '/')
        OR CASE WHEN len(a.s) <= len(b.s) THEN len(a.s) > 0 AND list_has_all(b.s, a.s) ELSE len(b.s) > 0 AND list_has_all(a.s, b.s) END) AS fuzzy,
       (a.v = b.v OR starts_with(a.v, b.v || '/') OR starts_with(b.v, a.v || '/')) AS domain
FROM s a JOIN s b ON a.p_name < b.p_name AND list_has_any(a.s, b.s)
"""


def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels made from doc_id, by what a request may see."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % k + 1).cast("int"))
    d = F.struct(
        F.when(F.col("doc_id") % 11 == 0, "deprecated").otherwise("active").alias("status"),
        pick(("private", "project", "team"), 3).alias("visibility"),
        pick(("public", "internal", "confidential", "secret"), 4).alias("sensitivity"),
        F.when(F.col("doc_id") % 7 == 0, "2026-01-01").otherwise("2024-01-01").alias("valid_from"),
        F.when(F.col("doc_id") % 5 == 0, "2024-12-31").alias("valid_until"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("p"), (F.col("doc_id") % 6).cast("string")))).otherwise(F.array().cast("array<string>")).alias("project_keys"),
    )
    q = F.struct(F.lit("2025-06-01").alias("now"), F.array(F.lit("project"), F.lit("team")).alias("visibility_scopes"), F.lit("internal").alias("clearance"), F.array(F.lit("p2")).alias("project_keys"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", d.alias("d"), q.alias("q")).where(access.is_accessible("d", "q")).select("doc_id", "lang", F.col("d.visibility").alias("visibility"), F.col("d.sensitivity").alias("sensitivity"))


ACCESS_FILTER = """
WITH d AS (SELECT doc_id, lang, ['private', 'project', 'team'][doc_id % 3 + 1] AS visibility, ['public', 'internal', 'confidential', 'secret'][doc_id % 4 + 1] AS sensitivity FROM documents
           WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 4 < 2)
SELECT * FROM d WHERE visibility = 'team' OR (visibility = 'project' AND (doc_id % 2 <> 0 OR doc_id % 6 = 2))
"""


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) of every document that holds at least half of a passage's tokens as substrings.

    Passages and documents meet in packed blocks; a document's set of tokens is a bit set, held
    against those of all passages of a block.
    """
    asked = table(spark, sf_dir, "benchmark").select("item_id", text.query_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("hay"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = tokens = wanted = None
        for rb in batches:
            for r in range(len(rb)):
                passages = rb.column(0)[r].as_py()
                if passages != seen:
                    seen, tokens = passages, Substrings({t for p in passages for t in p["tokens"]})
                    wanted = [(p["item_id"], tokens.of(p["tokens"]), len(p["tokens"])) for p in passages]
                items, docs = [], []
                for doc in rb.column(1)[r].as_py():
                    held = tokens.held(doc["hay"])
                    good = [item for item, own, size in wanted if (own & held).bit_count() * 2 >= size]
                    items += good
                    docs += [doc["doc_id"]] * len(good)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, pa.int64())], names=["item_id", "doc_id"])

    passages, parts = dealt(asked, "item_id", "passages", ("tokens",), 256)
    return meet(passages, packed(docs, "doc_id", "rows", ("hay",), 256), parts).mapInArrow(judged, "item_id long, doc_id long")


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the lexical ranking; a document is relevant to a passage if it holds at least half of its tokens.

    All documents are judged, found or not. Only counts of the relevant ones are kept for each
    passage; the found ones are told apart by rank.
    """
    top = bm25_topk(spark, sf_dir).select("item_id", "doc_id", "rank")
    judged = _relevant(spark, sf_dir).distinct().join(top, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("_all"), F.collect_list("rank").alias("_ranks"))
    asked = table(spark, sf_dir, "benchmark").select("item_id").where(F.size(text.query_tokens(F.col("text"))) > 0)
    rows = asked.join(judged, "item_id", "left").select("item_id", F.coalesce("_all", F.lit(0)).alias("_n"), F.coalesce("_ranks", F.array().cast("array<int>")).alias("_r"))
    n, r = F.col("_n"), F.col("_r")
    gains = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1.0))
    of_all = lambda value: F.round(F.when(n == 0, 1.0).otherwise(value), 6)
    within = lambda k: F.size(F.filter(r, lambda x: x <= k)) / n
    ideal = gains(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(5)).cast("int"))))
    return rows.select("item_id", n.cast("int").alias("relevant"), of_all(within(1)).alias("recall_1"), of_all(within(3)).alias("recall_3"), of_all(F.coalesce(1.0 / F.array_min(r), F.lit(0.0))).alias("reciprocal_rank"), of_all(gains(r) / ideal).alias("ndcg_5"))


EVAL_METRICS = f"""
WITH {_HITS},
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hits QUALIFY rank <= 5),
ql AS (SELECT item_id, list(raw) AS l FROM qt GROUP BY item_id),
good AS (SELECT item_id, doc_id FROM ql CROSS JOIN documents d WHERE len(list_filter(l, lambda x: contains(lower(d.text), x))) * 2 >= len(l)),
a AS (SELECT ql.item_id, count(g.doc_id) AS relevant, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (rank IS NOT NULL), 0) AS dcg
      FROM ql LEFT JOIN good g USING (item_id) LEFT JOIN top ON top.item_id = g.item_id AND top.doc_id = g.doc_id GROUP BY ql.item_id),
i AS (SELECT n, sum(1 / log2(k + 1)) AS ideal FROM (SELECT unnest([1, 2, 3, 4, 5]) AS n) JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) ON k <= n GROUP BY n)
SELECT item_id, CAST(relevant AS INTEGER) AS relevant, CASE WHEN relevant = 0 THEN 1.0 ELSE round(h1 / relevant, 6) END AS recall_1, CASE WHEN relevant = 0 THEN 1.0 ELSE round(h3 / relevant, 6) END AS recall_3,
       CASE WHEN relevant = 0 THEN 1.0 ELSE round(coalesce(1.0::DOUBLE / first, 0.0), 6) END AS reciprocal_rank, CASE WHEN relevant = 0 THEN 1.0 ELSE round(dcg / ideal, 6) END AS ndcg_5
FROM a LEFT JOIN i ON i.n = least(a.relevant, 5)
"""


def context_budget(spark: SparkSession, sf_dir: str, budget: int = 3000) -> DataFrame:
    """Greedy packing of each passage's five best documents by estimated tokens; what does not fit is passed over."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))
    rows = bm25_topk(spark, sf_dir).join(docs, "doc_id")
    return packet.budgeted(rows, "tokens", budget, "rank", "item_id").select("item_id", "doc_id", "rank", "tokens", "taken")


CONTEXT_BUDGET = f"""
WITH RECURSIVE {_HITS},
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hits QUALIFY rank <= 5),
c AS (SELECT item_id, top.doc_id, rank, CAST(ceil(length(d.text) / 4) AS BIGINT) AS tokens FROM top JOIN documents d USING (doc_id)),
w(item_id, rank, used, doc_id, tokens, taken) AS (
  SELECT item_id, rank, CASE WHEN tokens <= 3000 THEN tokens ELSE 0 END, doc_id, tokens, tokens <= 3000 FROM c WHERE rank = 1
  UNION ALL SELECT c.item_id, c.rank, CASE WHEN w.used + c.tokens <= 3000 THEN w.used + c.tokens ELSE w.used END, c.doc_id, c.tokens, w.used + c.tokens <= 3000 FROM w JOIN c ON c.item_id = w.item_id AND c.rank = w.rank + 1)
SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, tokens, taken FROM w
"""


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of all conversation turns: features in use and sum of components."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    v = embeddings.hash_embed(turns, "id", "text")
    return v.select("id", F.size(F.filter("vector", lambda x: x != 0)).alias("features"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


EMBED_HASH = r"""
WITH t AS (SELECT conv_id || ':' || turn AS id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_/-]+'), lambda x: length(x) BETWEEN 2 AND 48)) AS l FROM conversations),
e AS (SELECT id, sha256(x) AS h FROM (SELECT id, unnest(l) AS x FROM t)),
b AS (SELECT id, CAST(('0x' || h[1:4]) AS INTEGER) % 64 AS b, sum(CASE WHEN CAST(('0x' || h[5:6]) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM e GROUP BY ALL),
n AS (SELECT id, count(*) FILTER (v <> 0) AS features, sum(v) AS s, sqrt(sum(v * v)) AS norm FROM b GROUP BY id)
SELECT t.id, CAST(coalesce(features, 0) AS INTEGER) AS features, round(coalesce(CASE WHEN norm = 0 THEN 0 ELSE s / norm END, 0), 5) AS total FROM t LEFT JOIN n USING (id)
"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_normalised, evidence_gate, token_stats, dense_topk, hybrid_rrf, label_match, access_filter, eval_metrics, context_budget, embed_hash)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
