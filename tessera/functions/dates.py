"""Dates, local days and status as of a day (DAT operators); nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STALE_DAYS = 75
ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_date(c: Column | str) -> Column:
    """A real date written YYYY-MM-DD, else null."""
    return F.when(F.rlike(_c(c), F.lit(ISO)), F.try_to_date(_c(c), "yyyy-MM-dd"))


def instant(c: Column | str) -> Column:
    """An ISO timestamp; one without an offset is UTC (the session zone must be UTC)."""
    return F.try_to_timestamp(_c(c))


def local_date(ts: Column | str, zone: str) -> Column:
    """DAT-03: the date it was at ``ts`` in the zone."""
    return F.to_date(F.from_utc_timestamp(_c(ts), zone))


def day_start(day: Column | str, zone: str) -> Column:
    """DAT-03: the instant a local day began, as a UTC timestamp."""
    return F.to_utc_timestamp(_c(day).cast("timestamp"), zone)


def status_as_of(state: Column | str, deadline: Column | str, verified_at: Column | str, today: Column, zone: str) -> Column:
    """DAT-01: live, closed or stale on a local date.

    Dated rows are live all of their day; rolling and unstated ones go stale
    once their check is over ``STALE_DAYS`` old; everything else is stale.
    """
    state = _c(state)
    due = strict_date(deadline)
    age = F.datediff(today, local_date(instant(verified_at), zone))
    return (
        F.when(state == "closed", "closed")
        .when((state == "dated") & (due < today), "closed")
        .when((state == "dated") & due.isNotNull(), "live")
        .when(state.isin("rolling-confirmed", "not-stated") & (age <= STALE_DAYS), "live")
        .otherwise("stale")
    )


def status_spans(state: Column | str, deadline: Column | str, verified_at: Column | str, zone: str) -> Column:
    """STM-09: the statuses of a row over all days, in order: array of struct(status, since, until).

    ``since`` is the first day, null for the first status; ``until`` the day
    after the last, null for the last one.  On every day the span that holds
    it has the status of ``status_as_of``.
    """
    state = _c(state)
    due = strict_date(deadline)
    seen = local_date(instant(verified_at), zone)
    never = F.lit(None).cast("date")
    span = lambda status, since, until: F.struct(F.lit(status).alias("status"), since.alias("since"), until.alias("until"))
    always = lambda status: F.array(span(status, never, never))
    change = lambda first, second, day: F.array(span(first, never, day), span(second, day, never))
    return (
        F.when(state == "closed", always("closed"))
        .when((state == "dated") & due.isNotNull(), change("live", "closed", F.date_add(due, 1)))
        .when(state.isin("rolling-confirmed", "not-stated") & seen.isNotNull(), change("live", "stale", F.date_add(seen, STALE_DAYS + 1)))
        .otherwise(always("stale"))
    )


def closed_at(deadline: Column | str, zone: str) -> Column:
    """DAT-02: local midnight after the deadline, in UTC; null without a date."""
    return day_start(F.date_add(strict_date(deadline), 1), zone)


def last_week(now: Column | str, zone: str) -> Column:
    """DAT-04: struct(start, end) in UTC of the last whole local week from Monday to Sunday."""
    monday = F.date_trunc("week", F.from_utc_timestamp(_c(now), zone))
    return F.struct(
        F.to_utc_timestamp(monday - F.expr("INTERVAL 7 DAYS"), zone).alias("week_start"),
        F.to_utc_timestamp(monday, zone).alias("week_end"),
    )


def add_months(month: Column | str, n: int) -> Column:
    """DAT-05: ``YYYY-MM`` moved by n months."""
    return F.date_format(F.add_months(F.to_date(F.concat(_c(month), F.lit("-01"))), n), "yyyy-MM")


def months_before(month: Column | str, n: int) -> Column:
    """DAT-05: the n months before one, oldest first."""
    first = F.to_date(F.concat(_c(month), F.lit("-01")))
    every = F.sequence(F.add_months(first, -n), F.add_months(first, -1), F.expr("INTERVAL 1 MONTH"))
    return F.transform(every, lambda d: F.date_format(d, "yyyy-MM"))


def deadline_kind(state: Column | str, deadline: Column | str, today: Column) -> Column:
    """DAT-06: struct(kind, days): dated, rolling-confirmed, rolling, closed or unknown, and the days left."""
    state = _c(state)
    due = F.to_date(F.try_to_timestamp(F.substring(_c(deadline), 1, 10), F.lit("yyyy-MM-dd")))
    days = F.datediff(due, today)
    legacy = state.isNull() & (F.lower(F.trim(_c(deadline))) == "rolling")
    kind = (
        F.when(state == "closed", "closed")
        .when(state == "rolling-confirmed", "rolling-confirmed")
        .when(state == "unresolved", "unknown")
        .when(due.isNull() & legacy, "rolling")
        .when(due.isNull(), "unknown")
        .when(days < 0, "closed")
        .otherwise("dated")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "dated", days).alias("days"))


def cooldown(triggered_at: Column | str, now: Column, days: int = 7) -> Column:
    """DAT-07: struct(expires_at, remaining_seconds, expired) of a cooldown from its trigger; null without one."""
    ends = _c(triggered_at) + F.expr(f"INTERVAL {days} DAYS")
    left = F.greatest(F.lit(0), F.unix_timestamp(ends) - F.unix_timestamp(now))
    return F.when(
        _c(triggered_at).isNotNull(),
        F.struct(ends.alias("expires_at"), left.cast("bigint").alias("remaining_seconds"), (left <= 0).alias("expired")),
    )
