"""Versions, change data and reports (CDC and AGG-10..22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import filters

#: Facts compared between snapshots.
FACTS = ("title", "funder", "deadline", "deadline_state", "amount_min", "amount_max", "currency", "region", "eligibility", "status")


def diff(previous: DataFrame, current: DataFrame, facts: tuple[str, ...] = FACTS) -> DataFrame:
    """CDC-02: (id, change, fields) with change new, changed or closed; a pure closure is not a change."""
    p = previous.select("id", F.struct(*facts).alias("p"), F.lit(True).alias("known"))
    both = current.select("id", F.struct(*facts).alias("c")).join(p, "id", "left")
    fields = F.array_compact(F.array(*(F.when(~F.col(f"c.{f}").eqNullSafe(F.col(f"p.{f}")), f) for f in facts)))
    both = both.withColumn("fields", F.when(F.col("known"), fields).otherwise(F.array().cast("array<string>")))
    closed = F.col("known") & (F.col("c.status") == "closed") & (F.col("p.status") != "closed")
    changed = F.col("known") & (F.size("fields") > 0) & ~(closed & (F.size("fields") == 1))
    kinds = F.array_compact(F.array(F.when(F.col("known").isNull(), "new"), F.when(changed, "changed"), F.when(closed, "closed")))
    return both.select("id", F.explode(kinds).alias("change"), "fields").withColumn("fields", F.when(F.col("change") == "changed", F.col("fields")).otherwise(F.array().cast("array<string>")))


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], version: int) -> None:
    """SRC-15, CDC-01: all tables of a version, then the pointer that makes it current.

    Readers follow the pointer, so a failure before its last step leaves the
    version before in place.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/_pointers")


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current version."""
    version = spark.read.parquet(f"{path}/_pointers").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version}/{name}")


def latest_month(months: DataFrame, before: str, lookback: int = 6) -> DataFrame:
    """SRC-06: latest snapshot month at or before one, at most ``lookback`` months back."""
    first = F.date_format(F.add_months(F.to_date(F.lit(before + "-01")), 1 - lookback), "yyyy-MM")
    return months.where(F.col("month").between(first, F.lit(before))).agg(F.max("month").alias("month"))


def meta(listings: DataFrame) -> DataFrame:
    """AGG-10: counts by effective status and distinct funders listed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    listed = F.when(F.col("status").isin("live", "closed"), F.col("funder"))
    return listings.agg(F.count("*").alias("total"), n("live"), n("closed"), n("stale"), F.count_distinct(listed).alias("funder_count"))


def funder_summary(listings: DataFrame) -> DataFrame:
    """AGG-11: live and closed counts by funder slug, the name of the smallest id."""
    slug = text.slug("funder")
    return listings.where(slug != "").groupBy(slug.alias("slug")).agg(
        F.min_by("funder", "id").alias("name"),
        F.count_if(F.col("status") == "live").alias("live_count"),
        F.count_if(F.col("status") == "closed").alias("closed_count"),
    )


def gate_report(candidates: DataFrame) -> DataFrame:
    """AGG-12, AGG-13: candidates by reason (before a colon or the offending value), null reason for publishable ones."""
    reason = F.regexp_extract(filters.held_reason(), "^[^:(]*", 0)
    return candidates.groupBy(F.trim(reason).alias("reason")).agg(F.count("*").alias("n"))


def coverage_by_tier(register: DataFrame, rows: DataFrame) -> DataFrame:
    """AGG-14: funders, present ones and the sorted missing names by tier."""
    have = rows.select(F.lower("funder").alias("__n")).distinct().withColumn("__has", F.lit(True))
    joined = register.join(have, F.lower("name") == F.col("__n"), "left")
    return joined.groupBy("tier").agg(
        F.count("*").alias("funders"),
        F.count("__has").alias("present"),
        F.array_sort(F.collect_list(F.when(F.col("__has").isNull(), F.col("name")))).alias("missing"),
    )


def cited(answers: DataFrame, own: str) -> DataFrame:
    """AGG-15: ordered distinct domains of an answer, whether ``own`` is among them or above one, and its rank."""
    domains = F.array_distinct(F.filter(F.transform("urls", text.domain), lambda d: d != ""))
    out = answers.withColumn("domains", domains)
    hits = F.transform("domains", lambda d: (d == own) | F.endswith(d, F.lit("." + own)))
    place = F.array_position(hits, F.lit(True))
    return out.withColumns({"cited": place > 0, "rank": F.when(place > 0, place)})


def citation_summary(answers: DataFrame) -> DataFrame:
    """AGG-15: asked, errors, cited and best rank by provider."""
    return answers.groupBy("provider").agg(
        F.count("*").alias("asked"), F.count("error").alias("errors"), F.count_if("cited").alias("cited"), F.min("rank").alias("best_rank")
    )


def shared_urls(listings: DataFrame) -> DataFrame:
    """AGG-21: (url, id, n) of the rows whose url several rows share; one row each, so a hot url fills no single one."""
    rows = listings.select("id", text.normalise_url("source_url").alias("url")).where("url <> ''")
    return rows.join(rows.groupBy("url").agg(F.count("*").alias("n")).where("n > 1"), "url")


def sweep_summary(changes: DataFrame, listings: DataFrame, today: Column, first: int = 10) -> DataFrame:
    """AGG-18: counts of the change set, rows closing within 30 days and the first new live ids."""
    n = changes.agg(F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "changed").alias("changed"))
    soon = listings.where((F.col("status") == "live") & filters.in_bucket("30d", today)).agg(F.count("*").alias("closing"))
    fresh = changes.where("change = 'new'").select("id").join(listings.where("status = 'live'").select("id"), "id").orderBy("id").limit(first)
    ids = fresh.agg(F.array_sort(F.collect_list("id")).alias("first_new"))
    return n.crossJoin(soon).crossJoin(ids)


def shares(rows: DataFrame, column: str) -> DataFrame:
    """AGG-19: count and percentage by value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(100 * F.col("n") / F.col("__t"), 1).alias("percent"))


def crawl_estimate(pages: DataFrame, column: str, chars_per_token: int = 4) -> DataFrame:
    """AGG-20: pages, characters and estimated tokens."""
    return pages.agg(F.count("*").alias("pages"), F.sum(F.length(column)).alias("chars"), (F.sum(F.length(column)) / chars_per_token).cast("bigint").alias("tokens"))


def facts_by_category(facts: DataFrame) -> DataFrame:
    """AGG-22: ordered key=value entries of a category."""
    entry = F.concat_ws("=", "key", "value")
    return facts.groupBy("owner", "category").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def expand_changes(changes: DataFrame, listings: DataFrame) -> DataFrame:
    """JON-04, TOP-08: change entries with their listing; ids that are stale by now are left out."""
    shown = listings.where(F.col("status").isin("live", "closed")).select("id", "title", "status")
    return changes.join(shown, "id")


def feed(entries: DataFrame, limit: int = 200) -> DataFrame:
    """TOP-08: new before changed before closed, by id, at most ``limit``."""
    kind = F.when(F.col("change") == "new", 0).when(F.col("change") == "changed", 1).otherwise(2)
    return entries.orderBy(kind, "id").limit(limit)


def write_back(rows: DataFrame, answers: DataFrame, today: Column, cap: int, group: str | None = None) -> DataFrame:
    """CDC-06: vague rows take the answered deadline, the first ``cap`` changes in ``pos`` order; a past date becomes TBC and the key's end follows.

    The cap counts changed rows alone; it runs by ``group`` where given.
    """
    from tessera.functions import dates

    due = dates.strict_date("answer")
    new = F.when(due < today, F.lit("TBC")).otherwise(F.col("answer"))
    joined = rows.join(answers.select("id", "answer"), "id", "left").withColumn("__new", F.when(filters.vague() & F.col("answer").isNotNull(), new))
    differs = F.coalesce(F.col("__new") != F.col("deadline"), F.lit(False))
    w = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    if group is None:
        # only the rows that change compete for the cap, so only they meet
        changing = joined.where(differs).select("pos").orderBy("pos").limit(cap).withColumn("__take", F.lit(True))
        out = joined.join(changing, "pos", "left").withColumn("__take", F.coalesce("__take", F.lit(False)))
    else:
        out = joined.withColumn("__take", differs & (F.sum(differs.cast("int")).over(w) <= cap))
    value = F.when(F.col("__take"), F.col("__new")).otherwise(F.col("deadline"))
    key = F.when(F.col("__take"), F.lower(F.concat(F.regexp_replace("dedupe_key", "[^|]*$", ""), F.col("__new")))).otherwise(F.col("dedupe_key"))
    return out.withColumns({"deadline": value, "dedupe_key": key, "resolved": F.col("__take")}).drop("__new", "__take", "answer")


def reconcile(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """CDC-07: plan of every organisation by its latest subscription event; licensed ones stay as they are."""
    last = events.groupBy("org_id").agg(F.max_by("plan", F.struct("ts", "event_id")).alias("__plan"))
    plan = F.when(F.col("tier_source") == "licence", F.col("plan")).otherwise(F.coalesce("__plan", F.lit("free")))
    return orgs.join(last, "org_id", "left").withColumns({"new_plan": plan, "changed": ~plan.eqNullSafe(F.col("plan"))}).drop("__plan")


def merge_runs(first: DataFrame, second: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """CDC-05: union of two runs, the best row of every key."""
    from tessera.operators.resolve import first_rows

    return first_rows(first.unionByName(second), key, order)


def _spans(rows: DataFrame, zone: str) -> DataFrame:
    spans = dates.status_spans("deadline_state", "deadline", "verified_at", zone)
    return rows.select("id", F.posexplode(spans).alias("k", "s"), spans.alias("all")).select("id", "k", "s.*", "all")


def status_flips(rows: DataFrame, first: Column, last: Column, zone: str) -> DataFrame:
    """STM-09: (id, day, before, after): every change of status on the days from ``first`` to ``last``.

    Read off the spans of each row, however many days are asked for.
    """
    flips = _spans(rows, zone).where("k > 0").where(F.col("since").between(first, last))
    return flips.select("id", F.col("since").alias("day"), F.get("all", F.col("k") - 1)["status"].alias("before"), F.col("status").alias("after"))


def status_days(rows: DataFrame, first: Column, last: Column, zone: str) -> DataFrame:
    """STM-09: (day, status, n) of every day from ``first`` to ``last``, by a sweep over the starts and ends of spans.

    Spans become changes of a count, which are summed by day before the days
    are swept; a status without rows has a zero.
    """
    spans = _spans(rows, zone).select("status", F.greatest(F.coalesce("since", first), first).alias("on"), "until")
    spans = spans.where(F.col("on") <= last).where(F.col("until").isNull() | (F.col("until") > first))
    change = lambda day, n: F.struct(day.alias("day"), F.lit(n).cast("long").alias("n"))
    steps = F.array(change(F.col("on"), 1), change(F.col("until"), -1))
    changes = spans.select("status", F.explode(steps).alias("c")).select("status", "c.*").where(F.col("day").isNotNull() & (F.col("day") <= last))
    one = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    grid = one.select("day", F.explode(F.array(F.lit("live"), F.lit("closed"), F.lit("stale"))).alias("status"), F.lit(0).cast("long").alias("n"))
    daily = changes.unionByName(grid).groupBy("status", "day").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("status").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return daily.select("day", "status", running.alias("n"))
