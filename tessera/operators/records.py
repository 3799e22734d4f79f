"""Snapshots, evidence, registers and subscribers as tables (SRC-05, 07, 09, 16, 17, 19, AGG-17, STR-05, DED-10, 11, CDC-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import extract, filters, publish, resolve
from tessera.session import written


def read_pool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-05: rows of a snapshot file, ``{"opportunities": [...]}`` or a bare array, with their place ``pos``; elements that are no objects are dropped, an unreadable file is empty."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.opportunities", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = whole.select(F.posexplode(items).alias("pos", "row")).where("schema_of_variant(row) LIKE 'OBJECT%'")
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    return rows.select("pos", *(F.try_variant_get("row", f"$.{n}", t).alias(n) for n, t in fields))


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-07: every evidence file below a run's directory, whatever its depth, but not the index."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "EV-*.json").option("multiLine", True).json(path)


def dimension(spark: SparkSession, manifest: dict, key: str) -> DataFrame:
    """SRC-09: (name, value) rows of one map of a country manifest; a missing key gives no rows."""
    pairs = [(k, v) for k, vs in manifest.get(key, {}).items() for v in (vs if isinstance(vs, list) else [vs])]
    return spark.createDataFrame(pairs, "name string, value string")


def append_usage(usage: DataFrame, path: str) -> None:
    """SRC-16, SRC-08: append usage lines by organisation and day, so that one org-day is one partition."""
    usage.withColumn("date", F.to_date("ts")).write.partitionBy("org_id", "date").mode("append").parquet(path)


def seal(evidence: DataFrame, run: str, order: list[str], fields: list[str], already: int = 0) -> DataFrame:
    """SRC-17: add ``evidence_id`` (EV-0001 on within a run, more digits beyond 9,999) and ``hash``, SHA-256 over the sorted fields as JSON."""
    seq = F.row_number().over(Window.partitionBy(run).orderBy(*order)) + already
    sealed = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return evidence.withColumns({"evidence_id": F.concat(F.lit("EV-"), F.lpad(seq.cast("string"), F.greatest(F.lit(4), F.length(seq.cast("string"))), F.lit("0"))), "hash": F.sha2(sealed, 256)})


def tampered(evidence: DataFrame, fields: list[str]) -> DataFrame:
    """SRC-17: rows whose stored hash is not that of their fields."""
    return evidence.where(~F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256).eqNullSafe(F.col("hash")))


def case_summaries(cases: DataFrame) -> DataFrame:
    """SRC-19: fixed projection of cases with the sizes of their nested parts."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return cases.select("case_id", "status", size(F.map_keys("sections")).alias("sections"), size("uploads").alias("uploads"))


def canonical_funder(rows: DataFrame, aliases: DataFrame, column: str = "funder") -> DataFrame:
    """STR-05: add ``canonical``: an exact alias, an alias once parentheses are gone, or the bare name.

    The alias table (alias, name) is a country's configuration: small, and
    left to Spark to broadcast by its measured size.
    """
    a = aliases.select(F.lower(F.trim("alias")).alias("__a"), F.col("name").alias("__n")).dropDuplicates(["__a"])
    bare = text.strip_parentheses(column)
    first = rows.join(a, F.lower(F.trim(column)) == F.col("__a"), "left").withColumnRenamed("__n", "__exact").drop("__a")
    both = first.join(a, F.lower(bare) == F.col("__a"), "left").drop("__a")
    return both.withColumn("canonical", F.coalesce("__exact", "__n", F.nullif(bare, F.lit("")), F.trim(column))).drop("__exact", "__n")


def _words(c: Column | str, stop: tuple[str, ...]) -> Column:
    return F.array_distinct(F.filter(F.split(text.slug(c), "-"), lambda w: (w != "") & ~w.isin(*stop)))


def funder_matches(new: DataFrame, known: DataFrame, shared_hosts: tuple[str, ...], stop: tuple[str, ...] = ("the", "of", "trust", "fund", "foundation")) -> DataFrame:
    """DED-10: (name, known_name): the first known funder of the same site whose name agrees.

    Kinds must not conflict; on a site of their own the distinctive words must
    nest, on a shared host they must be equal.
    """
    n = new.select("name", text.domain("url").alias("site"), F.col("kind"), _words("name", stop).alias("w"))
    k = known.select(F.col("name").alias("known_name"), text.domain("url").alias("site"), F.col("kind").alias("k2"), _words("name", stop).alias("w2"), "pos")
    fits = n.join(k, "site").where("kind IS NULL OR k2 IS NULL OR kind = k2")
    a, b = F.size(F.array_except("w", "w2")) == 0, F.size(F.array_except("w2", "w")) == 0
    agree = F.when(F.col("site").isin(*shared_hosts), a & b).otherwise(a | b)
    return fits.where(agree).groupBy("name").agg(F.min_by("known_name", "pos").alias("known_name"))


def merge_register(new: DataFrame, known: DataFrame, aliases: DataFrame, shared_hosts: tuple[str, ...]) -> DataFrame:
    """DED-11: (name, tier, matched_by): each candidate goes to an alias, else a known site's funder, else stands as new; the best tier of all that meet."""
    named = canonical_funder(new, aliases, "name")
    by_alias = named.join(known.select(F.lower("name").alias("__k"), F.col("name").alias("__alias")), F.lower("canonical") == F.col("__k"), "left").drop("__k")
    matches = funder_matches(new, known, shared_hosts)
    target = by_alias.join(matches, "name", "left")
    final = F.coalesce("__alias", "known_name", "canonical")
    how = F.when(F.col("__alias").isNotNull(), "alias").when(F.col("known_name").isNotNull(), "site").otherwise("new")
    every = target.select(final.alias("final"), "tier", how.alias("how")).unionByName(known.select(F.col("name").alias("final"), "tier", F.lit("known").alias("how")))
    return every.groupBy("final").agg(F.min("tier").alias("tier"), F.array_sort(F.collect_set("how")).alias("matched_by")).withColumnRenamed("final", "name")


def _merged(previous: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of both, published ones flagged; survivors of their clusters)."""
    rows = previous.withColumn("published", F.lit(True)).unionByName(candidates.withColumn("published", F.lit(False)))
    return rows, resolve.survivors(rows, resolve.clusters(rows, resolve.edges(rows)))


def publish_cumulative(previous: DataFrame, candidates: DataFrame, today: Column, zone: str) -> DataFrame:
    """CDC-01: the cumulative dataset after a publish: gate, cluster, survivors, entities and status re-derived.

    ``previous`` and ``candidates`` have the model's columns with ``pos``
    unique over both.  Rows that the gate holds are left out; published rows
    stay whatever the run brought.
    """
    rows, kept = _merged(previous, candidates.where(filters.held_reason().isNull()))
    facts = rows.select(F.col("pos").alias("kept_pos"), "title", "funder", "deadline", "deadline_state", "verified_at", "amount_max", "eligibility")
    out = extract.entities(kept.join(facts, "kept_pos")).drop("eligibility")
    return out.withColumn("status", dates.status_as_of("deadline_state", "deadline", "verified_at", today, zone))


class PublishBlocked(Exception):
    """Funders that must appear have no publishable row."""


def publish_pool(
    spark: SparkSession, path: str, version: int, previous: DataFrame, candidates: DataFrame, expected: DataFrame, today: Column, zone: str,
    force: bool = False, dry_run: bool = False,
) -> dict[str, DataFrame]:
    """CDC-01, AGG-12: publish a run: the tables ``pool``, ``held``, ``must_appear`` and ``counts``, also returned.

    ``previous`` has ``status`` beside the model's columns.  A funder of
    ``expected`` (name) without a publishable row blocks the publish unless
    ``force``: then ``held`` alone is written, below ``blocked``, and
    ``PublishBlocked`` names the funders.  A dry run writes nothing.
    """
    held = candidates.withColumn("reason", filters.held_reason()).where("reason IS NOT NULL").select("pos", "title", "funder", "deadline_state", "reason")
    passed = candidates.where(filters.held_reason().isNull())
    must = resolve.must_appear(passed, expected)
    pool = written(publish_cumulative(previous.drop("status"), candidates, today, zone), "pool")
    was = previous.select("id", F.col("status").alias("was"))
    now = pool.join(was, "id", "left")
    count = lambda c, n: F.count_if(c).alias(n)
    totals = now.agg(
        F.count("*").alias("published_total"), count(F.col("was").isNull(), "new"), count((F.col("status") == "closed") & (F.col("was") != "closed"), "closed"),
        (F.sum("merged") - F.count("*")).alias("merges"), *(count(F.col("status") == s, f"{s}_total") for s in ("live", "stale", "closed")),
    )
    counts = candidates.agg(F.count("*").alias("candidates")).crossJoin(held.agg(F.count("*").alias("held"))).crossJoin(totals)
    tables = {"pool": pool, "held": held, "must_appear": must, "counts": counts}
    if dry_run:
        return tables
    # the register names tens of funders that must appear
    missing = [r["name"] for r in must.where("NOT present").orderBy("name").collect()]
    if missing and not force:
        held.write.mode("overwrite").parquet(f"{path}/blocked/version={version}")
        raise PublishBlocked(", ".join(missing))
    publish.publish(spark, path, tables, version)
    return tables
