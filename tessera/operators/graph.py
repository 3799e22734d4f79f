"""Link graph (GRA operators, DED-08, DED-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

DEPTH, KEPT, SEEN, LEAST_CHARS = 2, 8, 16, 300


def bounded_bfs(seeds: DataFrame, links: DataFrame, pages: DataFrame, depth: int = DEPTH, kept: int | None = KEPT, seen: int | None = SEEN) -> DataFrame:
    """GRA-01, GRA-02: (root, page_id, depth, parent, keep, reason): pages reached from each root.

    ``seeds`` have root and page_id, ``links`` src, dst and rank, ``pages``
    page_id, chars, funding.  Level by level: the frontier is joined to the
    links, a page already seen by its root is dropped, and the first ``seen``
    pages of a root in (depth, parent's rank, link's rank) order are visited;
    of those the first ``kept`` with enough text and a funding word are kept.
    One level is one round of shuffles on (root, page).
    """
    front = seeds.select("root", "page_id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place")).distinct()
    reached = front
    for level in range(1, depth + 1):
        step = front.join(links.withColumnRenamed("src", "page_id"), "page_id").select("root", F.col("dst").alias("next"), F.col("page_id").alias("parent"), "place", "rank")
        fresh = step.join(reached.select("root", F.col("page_id").alias("next")), ["root", "next"], "left_anti")
        first = fresh.groupBy("root", "next").agg(F.min_by("parent", F.struct("place", "rank")).alias("parent"), F.min(F.struct("place", "rank")).alias("o"))
        order = Window.partitionBy("root").orderBy("o.place", "o.rank", "next")
        front = first.withColumn("place", F.row_number().over(order).cast("long")).select("root", F.col("next").alias("page_id"), "parent", F.lit(level).alias("depth"), "place")
        front = written(front, "frontier")
        reached = reached.unionByName(front)
    whole = reached.join(pages, "page_id", "left")
    order = Window.partitionBy("root").orderBy("depth", "place", "page_id")
    if seen is not None:
        whole = whole.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= seen).drop("__n")
    reason = F.when(F.col("chars").isNull(), "not stored").when(F.col("chars") < LEAST_CHARS, "too short").when(~F.col("funding"), "no funding word")
    whole = whole.withColumn("reason", reason)
    good = F.count_if(F.col("reason").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0))
    keep = F.col("reason").isNull() & (good <= kept if kept is not None else F.lit(True))
    out = whole.withColumn("keep", keep)
    return out.withColumn("reason", F.when(~F.col("keep") & F.col("reason").isNull(), "enough pages").otherwise(F.col("reason"))).select("root", "page_id", "depth", "parent", "keep", "reason")


def choose_page(candidates: DataFrame) -> DataFrame:
    """GRA-03: (funder, url, stage): the first of listed guess, best link, search hit and home page."""
    stage = F.when(F.col("kind") == "listed", 0).when(F.col("kind") == "link", 1).when(F.col("kind") == "search", 2).otherwise(3)
    return candidates.groupBy("funder").agg(F.min_by("url", F.struct(stage, F.col("rank"), F.col("url"))).alias("url"), F.min(stage).alias("stage"))


def ancestors(parents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """DED-08: (page_id, ancestor) up to ``depth`` steps in a table of (page_id, parent)."""
    step = parents.select("page_id", F.col("parent").alias("ancestor")).where("ancestor IS NOT NULL")
    out, last = step, step
    for _ in range(depth - 1):
        up = parents.select(F.col("page_id").alias("ancestor"), F.col("parent").alias("above")).where("above IS NOT NULL")
        last = last.join(up, "ancestor").select("page_id", F.col("above").alias("ancestor"))
        out = out.unionByName(last)
    return out.distinct()


def prefer_dedicated(rows: DataFrame, parents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """DED-08: rows of an index page go where a page below it has a row of the same funder whose title nests with theirs and they add no deadline or amount."""
    above = ancestors(parents, depth)
    index = rows.select(F.col("id"), F.col("page_id").alias("ancestor"), "funder", F.lower("title").alias("t"), "deadline", "amount_max")
    below = rows.select(F.col("page_id"), F.col("funder").alias("f"), F.lower("title").alias("u"), F.col("deadline").alias("d2"), F.col("amount_max").alias("a2"))
    pairs = index.join(above, "ancestor").join(below, "page_id").where((F.col("funder") == F.col("f")) & (F.contains("u", F.col("t")) | F.contains("t", F.col("u"))))
    same = (F.col("deadline").isNull() | F.col("deadline").eqNullSafe(F.col("d2"))) & (F.col("amount_max").isNull() | F.col("amount_max").eqNullSafe(F.col("a2")))
    return rows.join(pairs.where(same).select("id").distinct(), "id", "left_anti")


def untranslated(frontier: DataFrame, own: DataFrame, language_key) -> DataFrame:
    """DED-13: pages whose language-neutral key is not among the pages in the site's own language."""
    keys = own.select(language_key("url").alias("__k")).distinct()
    return frontier.withColumn("__k", language_key("url")).join(keys, "__k", "left_anti").drop("__k")
