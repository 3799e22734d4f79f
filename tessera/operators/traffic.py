"""Event logs: recording, scans, counters and usage (SRC-01..04, 13..16, AGG-01..09, STM-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import classify, text

HIT_SCHEMA = "kind string, surface string, ts string, path string, agent string, ref string, ref_host string, ua string, role string, opp_id string, funder string"
SURFACES = ("page", "api", "mcp", "out")
PATH_CHARS, FUNDER_CHARS = 512, 200


def scan_lines(spark: SparkSession, path: str, schema: str = HIT_SCHEMA) -> DataFrame:
    """SRC-01: JSON objects, one a line; blank, broken and non-object lines are skipped, undecodable bytes replaced."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    parsed = lines.select(F.try_parse_json("line").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT%'")
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return parsed.select(*(F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in fields))


def field(c: Column | str) -> Column:
    """SRC-02: a string field; missing or empty is ``unknown``."""
    return F.coalesce(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("unknown"))


def record(requests: DataFrame) -> DataFrame:
    """SRC-13: log lines of raw requests (ts, kind, surface, path, user_agent, referrer, opp_id, funder).

    The path loses query and fragment, user agent and role stay for bots
    alone, the referring host for assistants and search engines alone; rows
    of an unknown surface are dropped.
    """
    landing, tag = F.coalesce("path", F.lit("")), F.col("__tag")
    named = requests.where(F.col("surface").isin(*SURFACES)).withColumns(
        {
            "agent": classify.agent("user_agent"),
            "__ref": classify.referrer("referrer"),
            "__host": classify._referrer_host(F.trim("referrer")),
            "__tag": classify.assistant_tag(landing),
        }
    )
    tagged = F.col("__ref").isin("direct", "other") & tag.isNotNull()
    ref = F.when(classify.email_tag(landing), "email").when(tagged, "assistant").otherwise(F.col("__ref"))
    kept = [c for c in ("event_id", "ts", "kind", "surface") if c in requests.columns]
    return named.select(
        *kept,
        F.substring(F.regexp_extract(landing, "^[^?#]*", 0), 1, PATH_CHARS).alias("path"),
        "agent",
        ref.alias("ref"),
        F.when(ref == "assistant", F.when(tagged, tag).otherwise(F.col("__host"))).when(ref == "search", F.col("__host")).alias("ref_host"),
        F.when(F.col("agent") != "human", F.substring("user_agent", 1, PATH_CHARS)).alias("ua"),
        F.when(F.col("agent") != "human", classify.role("user_agent")).alias("role"),
        F.substring("opp_id", 1, PATH_CHARS).alias("opp_id"),
        F.substring("funder", 1, FUNDER_CHARS).alias("funder"),
    )


def append(log: DataFrame, path: str, country: str) -> None:
    """SRC-03, SRC-13: append log lines by country and arrival month, so that a window reads only its months."""
    log.withColumns({"country": F.lit(country), "month": F.date_format("ts", "yyyy-MM")}).write.partitionBy("country", "month").mode("append").parquet(path)


def between(log: DataFrame, start: Column | str, end: Column | str) -> DataFrame:
    """SRC-04: lines with start <= ts < end; lines whose ts does not parse are dropped."""
    c = lambda x: F.lit(x).cast("timestamp") if isinstance(x, str) else x
    ts = F.try_to_timestamp(F.col("ts").cast("string"))
    return log.where((ts >= c(start)) & (ts < c(end)))


def months_between(start: str, end: str) -> Column:
    """SRC-03: the months a window touches, oldest first."""
    month = lambda x: F.trunc(F.lit(x).cast("date"), "month")
    return F.transform(F.sequence(month(start), month(end), F.expr("INTERVAL 1 MONTH")), lambda d: F.date_format(d, "yyyy-MM"))


def monthly_counters(log: DataFrame) -> DataFrame:
    """AGG-01: (counter, key, key2, n) for every counter of the lines, in one scan.

    Each line is counted under its own keys: one expand, one partial
    aggregation, one shuffle of counter rows.
    """
    hit, out = F.col("kind") == "hit", F.col("kind") == "clickout"
    role = F.coalesce(F.when(F.col("role").isin("fetch", "search", "training"), F.col("role")), F.when(F.col("ua").isNotNull(), classify.role("ua")))
    none = F.lit(None).cast("string")

    def entry(counter: str, when: Column, key: Column, key2: Column = none) -> Column:
        return F.when(when, F.struct(F.lit(counter).alias("counter"), key.alias("key"), key2.alias("key2")))

    entries = F.array(
        entry("hits_by_surface", hit, field("surface")),
        entry("hits_by_agent", hit, field("agent")),
        entry("hits_by_referrer", hit, field("ref")),
        entry("hits_by_agent_role", hit & role.isNotNull(), field("agent"), role),
        entry("api_calls_by_prefix", hit & (field("surface") == "api"), text.api_prefix(field("path"))),
        entry("mcp_calls_by_tool", hit & (field("surface") == "mcp") & F.startswith("path", F.lit("mcp:")), F.substring("path", 5, PATH_CHARS)),
        entry("clickouts_total", out, F.lit("all")),
        entry("clickouts_by_referrer", out, field("ref")),
        entry("clickouts_by_agent", out, field("agent")),
        entry("clickout_grants", out, field("opp_id")),
        entry("clickout_funders", out, field("funder")),
    )
    return log.select(F.explode(F.array_compact(entries)).alias("e")).groupBy("e.counter", "e.key", "e.key2").agg(F.count("*").alias("n"))


def top(counters: DataFrame, counter: str, n: int = 10) -> DataFrame:
    """AGG-02: the n largest keys of a counter, ties by key."""
    return counters.where(F.col("counter") == counter).select("key", "n").orderBy(F.desc("n"), "key").limit(n)


def weekly_counts(log: DataFrame) -> DataFrame:
    """AGG-03: one row a week (Monday) of the figures a weekly report states."""
    hit, human = F.col("kind") == "hit", F.col("agent") == "human"
    n = lambda c, name: F.count_if(c).alias(name)
    return log.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(
        n(hit, "hits"),
        n(hit & (F.col("role") == "fetch"), "assistant_fetches"),
        n(hit & (F.col("role") == "training"), "training"),
        n(hit & (F.col("role") == "search"), "search"),
        n(hit & human & (F.col("ref") == "assistant"), "assistant_referrals"),
        n(hit & human & (F.col("surface") == "page"), "human_pages"),
        n(hit & human & (F.col("ref") == "search"), "human_from_search"),
        n(hit & human & (F.col("ref") == "email"), "human_from_email"),
        n(F.col("kind") == "clickout", "clickouts"),
        n((F.col("kind") == "clickout") & (F.col("ref") == "assistant"), "assistant_clickouts"),
        n(hit & (F.col("surface") == "api"), "api_calls"),
        n(hit & (F.col("surface") == "mcp"), "mcp_calls"),
    )


def first_ever(log: DataFrame, end: str) -> DataFrame:
    """AGG-04: whether each headline event had happened before ``end``."""
    early = log.where(F.col("ts") < F.lit(end).cast("timestamp"))
    ever = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    hit, out = F.col("kind") == "hit", F.col("kind") == "clickout"
    return early.agg(
        ever(hit & F.coalesce(F.col("role") == "fetch", F.lit(False)), "assistant_fetch"),
        ever(hit & (F.col("ref") == "assistant") & (F.col("agent") == "human"), "assistant_referral"),
        ever(out & (F.col("ref") == "assistant"), "assistant_clickout"),
    )


def week_over_week(weeks: DataFrame) -> DataFrame:
    """AGG-05: (week, metric, n, before) with the same metric of the week before, 0 for a missing week."""
    metrics = [c for c in weeks.columns if c != "week"]
    long = weeks.unpivot(["week"], metrics, "metric", "n")
    earlier = long.select(F.date_add("week", 7).alias("week"), "metric", F.col("n").alias("before"))
    return long.join(earlier, ["week", "metric"], "left").withColumn("before", F.coalesce("before", F.lit(0)))


def public_usage(counters: DataFrame, least: int = 100) -> DataFrame:
    """AGG-06: fixed keys filled with 0, a bots total, and click-outs only from ``least`` up."""
    keys = [("surface", s) for s in SURFACES] + [("referrer", r) for r in ("assistant", "search", "email", "direct", "other")]
    dims = counters.sparkSession.createDataFrame(keys, "block string, key string")
    seen = counters.where(F.col("counter").isin("hits_by_surface", "hits_by_referrer")).select(
        F.when(F.col("counter") == "hits_by_surface", "surface").otherwise("referrer").alias("block"), "key", "n"
    )
    fixed = F.broadcast(dims).join(seen, ["block", "key"], "left").groupBy("block", "key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    totals = counters.agg(
        F.coalesce(F.sum(F.when((F.col("counter") == "hits_by_agent") & (F.col("key") != "human"), F.col("n"))), F.lit(0)).alias("bots"),
        F.coalesce(F.sum(F.when(F.col("counter") == "mcp_calls_by_tool", F.col("n"))), F.lit(0)).alias("tools"),
        F.coalesce(F.sum(F.when(F.col("counter") == "clickouts_total", F.col("n"))), F.lit(0)).alias("clickouts"),
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("bots").alias("key"), F.col("bots").alias("n")),
                F.struct(F.lit("tools").alias("key"), F.col("tools").alias("n")),
                F.struct(F.lit("clickouts").alias("key"), F.when(F.col("clickouts") >= least, F.col("clickouts")).alias("n")),
            )
        ).alias("t")
    )
    return fixed.unionByName(totals.select(F.lit("total").alias("block"), "t.key", "t.n"))


PRICES = (("model-O", "3.00", "15.00"), ("model-F", "0.80", "4.00"))
DEFAULT_PRICE = ("1.00", "5.00")


def cost(usage: DataFrame, prices=PRICES, default=DEFAULT_PRICE) -> DataFrame:
    """AGG-09: add ``cost_usd`` from tokens and the model's price per million, a default for unknown models."""
    dims = F.broadcast(usage.sparkSession.createDataFrame(list(prices), "model string, price_in string, price_out string"))
    price = lambda c, d: F.coalesce(F.col(c), F.lit(d)).cast("decimal(10,2)")
    joined = usage.join(dims, "model", "left")
    micro = F.col("input_tokens").cast("decimal(18,0)") * price("price_in", default[0]) + F.col("output_tokens").cast("decimal(18,0)") * price("price_out", default[1])
    return joined.withColumn("cost_usd", (micro / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")).drop("price_in", "price_out")


def usage_summary(priced: DataFrame) -> DataFrame:
    """AGG-07: calls, tokens and cost by organisation in total (caller null) and by caller; rounded last."""
    return priced.groupingSets([["org_id", "caller"], ["org_id"]], "org_id", "caller").agg(
        F.sum("api_calls").alias("api_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 4).cast("decimal(18,4)").alias("cost_usd"),
    )


def budget_days(usage: DataFrame, budget: int = 200, zone: str = "UTC") -> DataFrame:
    """AGG-08: calls of an organisation and local day against its budget."""
    day = F.to_date(F.from_utc_timestamp("ts", zone)).alias("day")
    used = usage.groupBy("org_id", day).agg(F.sum("api_calls").alias("used"))
    return used.withColumns({"left": F.greatest(F.lit(0).cast("bigint"), budget - F.col("used")), "allowed": F.col("used") < budget})


def daily_quota(usage: DataFrame, order: list[str], budget: int = 200, zone: str = "UTC") -> DataFrame:
    """STM-07: running calls of an organisation's local day; a call is allowed while those before it stay under the budget."""
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    before = Window.partitionBy("org_id", "day").orderBy("ts", *order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("api_calls").over(before), F.lit(0)).cast("bigint")
    return usage.withColumn("day", day).withColumn("used_before", used).withColumn("allowed", F.col("used_before") < budget)
