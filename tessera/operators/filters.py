"""Filters over listings (FLT operators); every one is a condition that Catalyst can push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, text

VAGUE = ("", "tbc", "tba", "rolling", "unknown", "varies")
#: Public amount bands: name -> (from, below).
BANDS = {"under-10k": (0, 10_000), "10k-50k": (10_000, 50_000), "50k-200k": (50_000, 200_000), "over-200k": (200_000, None)}
PUBLISHABLE = ("dated", "rolling-confirmed", "not-stated", "closed")


def haystack(folded: bool) -> Column:
    """Title, funder, summary, eligibility and tags as one searchable text."""
    parts = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "funder", "summary", "eligibility")), F.array_join("tags", " "))
    return text.fold(parts) if folded else F.lower(parts)


def search(listings: DataFrame, q: str, folded: bool = True) -> DataFrame:
    """FLT-01: rows that hold every term; the public search also folds accents."""
    hay = haystack(folded)
    for term in q.split():
        needle = text.fold(F.lit(term)) if folded else F.lower(F.lit(term))
        listings = listings.where(F.contains(hay, needle))
    return listings


def all_tags(wanted: list[str]) -> Column:
    """FLT-02."""
    return F.size(F.array_except(F.array(*(F.lit(t) for t in wanted)), F.transform("tags", F.lower))) == 0


def in_region(region: str, synonyms: tuple[str, ...] = ("national", "nationwide")) -> Column:
    """FLT-03: the region itself, or national under any of its names."""
    own = F.transform("region", lambda r: F.lower(F.trim(r)))
    return F.array_contains(own, region) | F.exists(own, lambda r: r.isin(*synonyms))


def due_before(day: str) -> Column:
    """FLT-04: due on the day or earlier; vague deadlines pass."""
    return F.coalesce(dates.strict_date("deadline") <= F.lit(day).cast("date"), F.lit(True))


def amount_overlaps(low: int | None, high: int | None) -> Column:
    """FLT-05, pool: ranges with open ends overlap; 0 is a bound."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & F.coalesce(F.col("amount_max") >= low, F.lit(True))
    if high is not None:
        keep = keep & F.coalesce(F.col("amount_min") <= high, F.lit(True))
    return keep


def stated_range() -> Column:
    """FLT-05, public: struct(low, high) a row states; 0 is not stated, contradictions are null."""
    low, high = F.when(F.col("amount_min") > 0, F.col("amount_min")), F.when(F.col("amount_max") > 0, F.col("amount_max"))
    both = F.struct(
        F.coalesce(low, F.lit(0)).cast("double").alias("low"), F.coalesce(high.cast("double"), F.lit(float("inf"))).alias("high")
    )
    return F.when((low.isNotNull() | high.isNotNull()) & F.coalesce(low <= high, F.lit(True)), both)


def in_band(band: str, currency: str) -> Column:
    """FLT-05, public: stated range in the country's currency overlaps the band, open above, closed below."""
    low, high = BANDS[band]
    own = stated_range()
    fits = (own["low"] < F.lit(float("inf") if high is None else float(high))) & (own["high"] >= low)
    return F.coalesce(fits & (F.upper("currency") == currency), F.lit(False))


def by_funder(name: str) -> Column:
    """FLT-06, pool."""
    return F.lower(F.trim("funder")) == name.strip().lower()


def in_bucket(bucket: str, today: Column) -> Column:
    """FLT-07: 30d and 90d nest; ``dated`` and ``rolling`` by state."""
    due = dates.strict_date("deadline")
    dated = (F.col("deadline_state") == "dated") & due.isNotNull()
    if bucket == "rolling":
        return F.col("deadline_state") == "rolling-confirmed"
    if bucket == "dated":
        return dated
    return dated & F.datediff(due, today).between(0, 30 if bucket == "30d" else 90)


def not_past(today: Column) -> Column:
    """FLT-08: past deadlines go, vague ones stay."""
    return F.coalesce(dates.strict_date(F.substring("deadline", 1, 10)) >= today, F.lit(True))


def vague() -> Column:
    """FLT-09."""
    return F.lower(F.trim(F.coalesce("deadline", F.lit("")))).isin(*VAGUE)


def held_reason() -> Column:
    """FLT-10: why a row may not be published, null if it may."""
    state = F.col("deadline_state")
    return (
        F.when(F.coalesce("verified_at", F.lit("")) == "", "not verified (no verified_at)")
        .when(~F.coalesce(state.isin(*PUBLISHABLE), F.lit(False)), F.concat(F.lit("deadline_state is "), F.coalesce(state, F.lit("missing"))))
        .when((state == "dated") & dates.strict_date("deadline").isNull(), "deadline_state is dated but deadline is no date")
        .when((F.trim(F.coalesce("title", F.lit(""))) == "") | (F.trim(F.coalesce("funder", F.lit(""))) == ""), "missing title or funder")
    )


def visible(listings: DataFrame, include: tuple[str, ...] = ("live", "closed")) -> DataFrame:
    """FLT-11: rows by effective status, stale ones only on request."""
    return listings.where(F.col("status").isin(*include))


def overlapping(column: str, wanted: list[str]) -> Column:
    """FLT-12: seeds without any value are universal, else one value must be wanted."""
    return (F.size(column) == 0) | F.arrays_overlap(column, F.array(*(F.lit(w) for w in wanted)))


def select_funders(register: DataFrame, tier: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """FLT-13: funders of a tier that have no row in an earlier run."""
    if tier is not None:
        register = register.where(F.col("tier") == tier)
    return register if earlier is None else register.join(earlier.select("name").distinct(), "name", "left_anti")


def not_excluded(funders: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """FLT-14: funders that hold none of the names as whole words."""
    pattern = "(?U)\\b(?:" + "|".join(names) + ")\\b"
    return funders.where(~F.rlike(F.lower("name"), F.lit(pattern)))


def check_profiles(profiles: DataFrame, sizes: tuple[str, ...], statuses: tuple[str, ...]) -> DataFrame:
    """FLT-15: add ``rejected`` (name of the first bad parameter, null if none) and a canonical ``profile_key``."""
    bad = lambda c, ok: F.col(c).isNotNull() & ~F.col(c).isin(*ok)
    pairs = F.array_compact(
        F.array(
            *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c))) for c in ("region", "status", "size", "need")),
            F.when(F.size("sector") > 0, F.concat(F.lit("sector="), F.array_join(F.array_sort("sector"), ","))),
        )
    )
    return profiles.withColumns(
        {
            "rejected": F.when(bad("size", sizes), "size").when(bad("status", statuses), "status"),
            "profile_key": F.array_join(F.array_sort(pairs), "&"),
        }
    )
