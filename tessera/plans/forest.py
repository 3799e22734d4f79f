"""Groups by ordered unions under a constraint, as a spanning forest found in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written


def _halved(parents: DataFrame) -> DataFrame:
    """Every node's pointer moved to where the pointer's own target points."""
    above = parents.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("to_held").alias("__held"))
    return parents.join(above, "to", "left").select(
        "node", F.coalesce("__to", "to").alias("to"), F.coalesce("__held", "to_held").alias("to_held")
    )


def _flat(parents: DataFrame) -> DataFrame:
    """Pointers that all end at roots; a path of n nodes takes log n rounds."""
    while True:
        parents = written(parents, "parents")
        if parents.join(parents.select(F.col("node").alias("to")), "to", "left_semi").isEmpty():
            return parents
        parents = _halved(parents)


def _moved(edges: DataFrame, parents: DataFrame, end: str) -> DataFrame:
    """``edges`` with the group at ``end`` replaced by the one it has joined."""
    p = parents.select(F.col("node").alias(end), "to", "to_held")
    names = [c for c in edges.columns if c not in (end, f"held_{end}")]
    return edges.join(p, end, "left").select(
        *names, F.coalesce("to", end).alias(end), F.coalesce("to_held", f"held_{end}").alias(f"held_{end}")
    )


def constrained_groups(nodes: DataFrame, links: DataFrame, order: list[str], max_rounds: int = 60) -> DataFrame:
    """(node, first): what unions along ``links`` (i, j), taken in ``order``, make of ``nodes`` (node, held).

    A union is refused if both groups have a held node.  ``first`` is the
    smallest node of a group.  Taking the links one by one with that rule is
    Kruskal's algorithm on the graph in which all held nodes hang on one more
    node by links that come before all others: a refused union would close a
    circle through it.  With links ordered without ties (``order``, then i, j)
    that spanning forest is unique, so it is found in rounds instead: every
    group without a held node takes its first link (an aggregation), groups
    join along these, and links inside a group or between two held groups are
    dropped.  Each round at least halves the open groups.

    Links that tell held_i and held_j are taken at their word, others meet the
    nodes.  They may repeat; nulls and links from a node to itself are left out.  A
    node without links is its own group.  Groups and links are rows throughout,
    so a group may be of any size.
    """
    held = nodes.select("node", F.coalesce("held", F.lit(False)).alias("held"))
    rank: Column = F.struct(*order, "i", "j")
    known = {"held_i", "held_j"} <= set(links.columns)
    told = [F.coalesce(f"held_{x}", F.lit(False)).alias(f"held_{y}") for x, y in ("ia", "jb")] if known else []
    edges = links.where("i IS NOT NULL AND j IS NOT NULL AND i <> j").select(rank.alias("rank"), F.col("i").alias("a"), F.col("j").alias("b"), *told)
    if not known:
        for end in ("a", "b"):
            edges = edges.join(held.select(F.col("node").alias(end), F.col("held").alias(f"held_{end}")), end)
    edges = written(edges.where("NOT (held_a AND held_b)"), "links")
    steps = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        ways = edges.where("NOT held_a").select("rank", F.col("a").alias("node"), F.col("b").alias("to"), F.col("held_b").alias("to_held"))
        back = edges.where("NOT held_b").select("rank", F.col("b").alias("node"), F.col("a").alias("to"), F.col("held_a").alias("to_held"))
        best = ways.unionByName(back).groupBy("node").agg(F.min(F.struct("rank", "to", "to_held")).alias("best"))
        chosen = written(best.select("node", "best.to", "best.to_held"), "chosen")
        # two groups that chose each other: the smaller one is the root
        facing = chosen.select(F.col("node").alias("to"), F.col("to").alias("node"))
        roots = chosen.join(facing, ["node", "to"], "left_semi").where("node < to").select("node")
        parents = _flat(chosen.join(roots, "node", "left_anti"))
        steps.append(parents)
        moved = _moved(_moved(edges, parents, "a"), parents, "b").where("a <> b AND NOT (held_a AND held_b)")
        turned = F.col("a") > F.col("b")
        ends = [
            F.when(turned, F.col(f"{x}{y}")).otherwise(F.col(f"{x}{z}")).alias(f"{x}{z}")
            for y, z in (("b", "a"), ("a", "b"))
            for x in ("", "held_")
        ]
        edges = written(moved.select("rank", *ends).groupBy("a", "held_a", "b", "held_b").agg(F.min("rank").alias("rank")), "links")
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    grouped = nodes.select("node", F.col("node").alias("group"))
    for parents in steps:
        p = parents.select(F.col("node").alias("group"), "to")
        grouped = grouped.join(p, "group", "left").select("node", F.coalesce("to", "group").alias("group"))
    grouped = written(grouped, "groups")
    first = grouped.groupBy("group").agg(F.min("node").alias("first"))
    return grouped.join(first, "group").select("node", "first")
