"""Connected components of an edge table, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir, written


def _ends(first: tuple[str, str], second: tuple[str, str]):
    """Two rows (u, v) of one, from two pairs of its columns."""
    return F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (first, second))))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step; edges are (u, v) with u > v.

    Each step reads what it is given twice, so that the plan of a round stays
    small: its size is what a round costs the driver.
    """
    both = edges.select(_ends(("u", "v"), ("v", "u"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(_ends(("v", "m"), ("u", "m")))
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node that has a smaller one beside it has that one alone and is no other's smaller one."""
    each = edges.select("u", "v", F.lit(1).alias("below"), F.lit(0).alias("above"))
    nodes = F.inline(F.array(F.struct(F.col("u").alias("node"), "below", "above"), F.struct(F.col("v").alias("node"), F.col("above").alias("below"), F.col("below").alias("above"))))
    found = each.select(nodes).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return found.where("below > 1 OR (below > 0 AND above > 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge names; root is the smallest node reachable.

    ``edges`` has two columns of one orderable type; order, repeats and self
    loops do not matter, rows with a null are left out.  Alternates large-star
    and small-star steps: O(log n) rounds, each a fixed number of shuffles on
    the node id, with the edge table written to the shared folder after every
    round so that the plan stays small and a lost executor costs one round,
    until every node is linked to its root alone.
    An empty table gives an empty result.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    a, b = edges.columns[:2]
    current = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("u > v")
        .distinct()
    )
    current = written(current, "components")
    for _ in range(max_rounds):
        if _settled(current):
            break
        current = written(_star(_star(current, True), False), "components")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
