"""Connected components of a graph of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import discard, settle


#: Parts that the links of one node are dealt over, so that the centre of a large star is no single task's.
SALTS = 64


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (u, v, m), least (u, m)): every link with the smallest neighbour of its u, and one row for each u.

    The smallest neighbour is found for each (u, part of v) and then over at most SALTS parts;
    links meet it by u and part, so no task holds all links of a node.
    """
    dealt = edges.withColumn("_s", F.expr(f"pmod(xxhash64(v), {SALTS})"))
    near = dealt.groupBy("u", "_s").agg(F.min("v").alias("m"))
    least = near.groupBy("u").agg(F.min("m").alias("m"))
    return dealt.join(near.select("u", "_s").join(least, "u"), ["u", "_s"]).select("u", "v", "m"), least


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of `links` (a, b); a component is its smallest node.

    Alternates large-star and small-star steps until the links stand still. Each round is
    aggregations and joins by node and part of its neighbours; nothing is collected but a count
    and a checksum. Every round is written to the shared folder, so a lost executor costs one
    round at most. A link from a node to itself makes it a component of its own if it has no
    other. discard() of the result deletes what it is read from.
    """
    own = links.where("a = b").select(F.col("a").alias("node")).distinct()
    now = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = _checksum(now)
    while seen[0]:
        both, least = _with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = settle(large, label)  # read three times by the next step
        rest, least = _with_least(large)
        small = rest.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = settle(small, label)
        discard(large)
        discard(now)
        now, before, seen = new, seen, _checksum(new)
        if seen == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    alone = own.join(stars.select("node").unionByName(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    out = stars.unionByName(roots).unionByName(alone)
    out._settled_path = now._settled_path
    return out


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
