"""Connected components of a large graph, by alternating stars (Kiveris et al., 2014).

Every step is a grouped minimum and a join on the node. The hub of a large component has very many neighbours, so the
arcs of a node are dealt over ``SALTS`` groups: minima are taken per group, then per node, and go back to the groups, so no
node's neighbours meet in one place. Each round is written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featurewatch.session import materialize


#: Groups over which the arcs of one node are dealt.
SALTS = 64


def _with_least(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``arcs`` (u, v) with ``m``, the least v of their u, and a table of u and m."""
    salted = arcs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("p"))
    least = parts.groupBy("u").agg(F.min("p").alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).drop("salt"), least


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """arcs (u, v). Large star: the neighbours above u move to the least of u and its neighbours.
    Small star: u and its neighbours below move to the least of those."""
    if large:
        both, _ = _with_least(arcs.union(arcs.select("v", "u")))
        out = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        arcs = arcs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        below, least = _with_least(arcs)
        out = below.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node that it is linked with) of every node that has a link. Links may repeat,
    lead from a node to itself (no link) or hold nulls (left out)."""
    arcs = materialize(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
                       .filter(f"{a} is not null and {b} is not null and {a} <> {b}").distinct())
    state = None
    while True:
        arcs = materialize(_star(_star(arcs, True), False))
        now = arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return arcs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                arcs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
