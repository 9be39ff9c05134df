"""Typed knowledge graphs: building, walking, viewing, writing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.access import EXPANDABLE
from quillmere.functions.text import mermaid_label, short_hash


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return short_hash("edge_", 20, source, target, kind)


def build(knowledge: DataFrame, proposals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents of every status, and of proposals (id, title, target_ids).

    Of several nodes with one id the first stays, in the order of document and of the list
    within it; of several edges between two nodes of one type the last stays.
    """
    own = F.concat(F.lit("knowledge:"), F.col("id"))
    items = []
    empty = lambda c: F.coalesce(F.col(c), F.array())

    def add(column: str, prefix: str, kind: str, edge: str, pick=lambda x: x, place: int = 0) -> None:
        items.append(knowledge.select(F.col("id").alias("_doc"), F.lit(place).alias("_place"), F.posexplode(empty(column)).alias("_at", "_x")).select("_doc", "_place", "_at", F.concat(F.lit("knowledge:"), "_doc").alias("source"), F.concat(F.lit(prefix), pick(F.col("_x"))).alias("target"), F.lit(kind).alias("kind"), pick(F.col("_x")).alias("label"), F.lit(edge).alias("type"), F.lit("{}").alias("metadata")))

    domains = knowledge.withColumn("_domain", F.array("domain"))
    items.append(domains.select(F.col("id").alias("_doc"), F.lit(0).alias("_place"), F.lit(0).alias("_at"), own.alias("source"), F.concat(F.lit("domain:"), "domain").alias("target"), F.lit("domain").alias("kind"), F.col("domain").alias("label"), F.lit("belongs_to_domain").alias("type"), F.lit("{}").alias("metadata")))
    add("scenarios", "scenario:", "scenario", "used_in_scenario", lambda x: x["id"], 1)
    add("project_keys", "project:", "project", "belongs_to_project", place=2)
    add("episodes", "episode:", "episode", "observed_in_episode", lambda x: x["episode_id"], 3)
    add("source", "source:", "source", "sourced_from", place=4)
    relations = knowledge.select(F.col("id").alias("_doc"), F.lit(5).alias("_place"), F.posexplode(empty("related_knowledge")).alias("_at", "_x"))
    items.append(relations.select("_doc", "_place", "_at", F.concat(F.lit("knowledge:"), "_doc").alias("source"), F.concat(F.lit("knowledge:"), "_x.id").alias("target"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("_x.relation").alias("type"), F.to_json(F.struct("_x.reason")).alias("metadata")))
    for place, column, edge in ((6, "supersedes", "supersedes"), (7, "conflicts_with", "conflicts_with")):
        add(column, "knowledge:", "", edge, place=place)
    every = items[0]
    for more in items[1:]:
        every = every.unionByName(more)
    documents = knowledge.select(F.col("id").alias("_doc"), F.lit(-1).alias("_place"), F.lit(0).alias("_at"), own.alias("id"), F.lit("knowledge").alias("type"), F.col("title").alias("label"), F.to_json(F.struct("id", "kind", "layer", "status", "domain", "synopsis", "confidence", "visibility", "sensitivity", "project_keys", "valid_from", "valid_until", "file_path")).alias("metadata"))
    leaves = every.where("kind <> ''").select("_doc", "_place", "_at", F.col("target").alias("id"), F.col("kind").alias("type"), "label", F.lit("{}").alias("metadata"))
    nodes, links = documents.unionByName(leaves), every.select("_doc", "_place", "_at", "source", "target", "type", "metadata")
    if proposals is not None:
        nodes = nodes.unionByName(proposals.select(F.lit("~").alias("_doc"), F.lit(0).alias("_place"), F.lit(0).alias("_at"), F.concat(F.lit("proposal:"), "id").alias("id"), F.lit("proposal").alias("type"), F.col("title").alias("label"), F.lit("{}").alias("metadata")))
        links = links.unionByName(proposals.select(F.lit("~").alias("_doc"), F.lit(0).alias("_place"), F.posexplode("target_ids").alias("_at", "_t"), "id").select("_doc", "_place", "_at", F.concat(F.lit("proposal:"), "id").alias("source"), F.concat(F.lit("knowledge:"), "_t").alias("target"), F.lit("proposes_change_to").alias("type"), F.lit("{}").alias("metadata")))
    nodes = nodes.groupBy("id").agg(F.min(F.struct("_doc", "_place", "_at", "type", "label", "metadata")).alias("_f")).select("id", "_f.type", "_f.label", "_f.metadata")
    edges = links.groupBy("source", "target", "type").agg(F.max(F.struct("_doc", "_place", "_at", "metadata")).alias("_l")).select(edge_id(F.col("source"), F.col("target"), F.col("type")).alias("id"), "source", "target", "type", "_l.metadata")
    return nodes, edges


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges in either direction; a loop once."""
    one = edges.select(F.col("id").alias("edge"), "type", F.col("source").alias("here"), F.col("target").alias("there"))
    return one.unionByName(edges.where("source <> target").select(F.col("id").alias("edge"), "type", F.col("target").alias("here"), F.col("source").alias("there")))


def expand(start: DataFrame, edges: DataFrame, depth: int = 1, decay: float = 0.6, allowed: tuple[str, ...] = EXPANDABLE) -> DataFrame:
    """(query_id, id, depth, score, type) reached from start (query_id, id) over edges of allowed types, either way.

    At most two levels, unrolled. A node has the depth at which it is first reached and the type
    of the edge with the smallest id that reaches it there. score = round(decay ^ depth, 6).
    """
    if not 1 <= depth <= 2:
        raise ValueError("depth is 1 or 2")
    ways = _both_ways(edges.where(F.col("type").isin(*allowed)))
    seen, front, out = start.select("query_id", "id").distinct(), start.select("query_id", "id").distinct(), None
    for level in range(1, depth + 1):
        reached = front.join(ways, F.col("id") == F.col("here")).select("query_id", F.col("there").alias("id"), "edge", "type").join(seen, ["query_id", "id"], "left_anti")
        found = reached.groupBy("query_id", "id").agg(F.min_by("type", "edge").alias("type")).select("query_id", "id", F.lit(level).alias("depth"), F.round(F.lit(float(decay) ** level), 6).alias("score"), "type")
        out = found if out is None else out.unionByName(found)
        front = found.select("query_id", "id")
        seen = seen.unionByName(front)
    return out


def expand_counts(start: DataFrame, edges: DataFrame, kind: Callable[[Column], Column], depth: int = 1, decay: float = 0.6, allowed: tuple[str, ...] = EXPANDABLE) -> DataFrame:
    """(query_id, depth, kind, n, score): how many nodes of each kind (an expression of the id) expand() reaches at each depth.

    Rows for each request and node are made for the first level only. Requests whose first levels
    are the same nodes are one class, told apart by number and two sums of 64-bit hashes: its
    second level is walked and counted once, and a request takes from it the starts it holds itself.
    """
    if not 1 <= depth <= 2:
        raise ValueError("depth is 1 or 2")
    ways = _both_ways(edges.where(F.col("type").isin(*allowed))).select("here", "there").distinct()
    start = start.select("query_id", "id").distinct()
    counted = lambda rows, *keys: rows.groupBy(*keys, kind(F.col("id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    shown = lambda rows, level: rows.select("query_id", F.lit(level).alias("depth"), "kind", "n", F.round(F.lit(float(decay) ** level), 6).alias("score"))
    reached = lambda front, *keys: front.join(ways, F.col("id") == F.col("here")).select(*keys, F.col("there").alias("id")).distinct()
    first = reached(start, "query_id").join(start, ["query_id", "id"], "left_anti")
    out = shown(counted(first, "query_id"), 1)
    if depth == 1:
        return out
    mark = lambda salt: F.sum(F.xxhash64(F.lit(salt), "id").cast("decimal(38,0)"))
    marked = first.groupBy("query_id").agg(F.struct(F.count(F.lit(1)), mark("a"), mark("b")).alias("_class"))
    front = first.join(marked.groupBy("_class").agg(F.min("query_id").alias("query_id")), "query_id").select("_class", "id")
    second = reached(front, "_class").join(front, ["_class", "id"], "left_anti")
    own = start.join(marked, "query_id").join(second, ["_class", "id"]).groupBy("query_id", kind(F.col("id")).alias("kind")).agg(F.count(F.lit(1)).alias("_own"))
    rest = marked.join(counted(second, "_class"), "_class").join(own, ["query_id", "kind"], "left").withColumn("n", F.col("n") - F.coalesce("_own", F.lit(0)))
    return out.unionByName(shown(rest.where("n > 0"), 2))


def query(nodes: DataFrame, edges: DataFrame, words: str | None = None, ids: list[str] | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within `depth` (0 to 2) steps of the nodes that hold a text or have the ids.

    Edges are those between reached node ids, also where a node of that id is missing.
    """
    hit = F.lit(False)
    if words:
        hit = hit | F.contains(F.lower(F.concat_ws(" ", "id", "label", "metadata")), F.lit(words.lower()))
    if ids:
        hit = hit | F.col("id").isin(*ids)
    seeds = nodes.where(hit).select("id").distinct()
    ways = _both_ways(edges)
    reached = seeds
    for _ in range(min(depth, 2)):
        reached = reached.unionByName(reached.join(ways, F.col("id") == F.col("here")).select(F.col("there").alias("id"))).distinct()
    inner = edges.join(reached.select(F.col("id").alias("source")), "source", "left_semi").join(reached.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes.join(reached, "id", "left_semi"), inner.select("id", "source", "target", "type", "metadata")


def view(nodes: DataFrame, edges: DataFrame, refined: DataFrame, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Refined documents (id) with what they touch, and counts by node type."""
    core = refined.select(F.concat(F.lit("knowledge:"), "id").alias("id")).distinct()
    touching = edges.join(core.select(F.col("id").alias("source")), "source", "left_semi").unionByName(edges.join(core.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)).distinct()
    ids = touching.select(F.col("source").alias("id")).unionByName(touching.select(F.col("target").alias("id"))).unionByName(core).distinct()
    shown = nodes.join(ids, "id", "left_semi")
    if types:
        shown = shown.where(F.col("type").isin(*types)).unionByName(shown.join(core, "id", "left_semi").where(~F.col("type").isin(*types)))
    kept = touching.join(shown.select(F.col("id").alias("source")), "source", "left_semi").join(shown.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)
    return shown, kept, shown.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Mermaid graph, in order (position, line); write them with a single sorted writer."""
    name = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(F.col(c).cast("binary"), 256), 1, 12))
    head = nodes.sparkSession.createDataFrame([(0, "", "graph LR")], "part int, key string, line string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), name("id"), F.lit('["'), mermaid_label(F.col("label")), F.lit('"]')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), name("source"), F.lit(" -->|"), mermaid_label(F.col("type")), F.lit("| "), name("target")).alias("line"))
    return head.unionByName(n).unionByName(e).orderBy("part", "key")


def components_of_levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth): smallest number of steps from each seed, up to `depth` levels."""
    ways = _both_ways(edges).select("here", "there").distinct()
    out = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    front = out
    for level in range(1, depth + 1):
        front = front.join(ways, F.col("id") == F.col("here")).select("seed", F.col("there").alias("id"), F.lit(level).alias("depth")).distinct()
        out = out.unionByName(front)
    return out.groupBy("seed", "id").agg(F.min("depth").alias("depth"))


