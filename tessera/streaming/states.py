"""Keyed state: admission by a sliding log, subscriber lifecycles, spend caps.

Each rule is one small step function.  The batch twin deals rows by key,
sorts them inside partitions and replays the steps row by row with one key's
state in memory; the stream keeps the same state in Spark's state store.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

RESEND, PENDING_TTL, RETENTION = 3600, 7 * 86_400, 30 * 86_400


def admit(log: deque, now: float, limit: int, window: float) -> float | None:
    """STM-03: None if the request at ``now`` is admitted, else the seconds to wait; refused ones leave no trace."""
    while log and log[0] <= now - window:
        log.popleft()
    if len(log) >= limit:
        return max(log[0] + window - now, 0.0)
    log.append(now)
    return None


def end_of(state: dict | None) -> tuple[str, float] | None:
    """STM-05: how and when a record ends if nothing happens: pending ones expire, unsubscribed ones are purged."""
    if state is None or (state["left"] is None and state["confirmed"] is not None):
        return None
    return ("expired", state["sent"] + PENDING_TTL) if state["left"] is None else ("purged", state["left"] + RETENTION)


def lifecycle(state: dict | None, event: str, now: float) -> tuple[dict | None, str]:
    """STM-04, STM-05: next state of an address and the outcome of an event.

    State: created, sent, confirmed, left (seconds or None).  A record that
    has outlived its end (``end_of``) is gone before the event acts.
    """
    if (end := end_of(state)) and now > end[1]:
        state = None
    phase = None if state is None else "left" if state["left"] is not None else "confirmed" if state["confirmed"] is not None else "pending"
    if event == "subscribe":
        if phase == "confirmed":
            return state, "already_confirmed"
        if phase == "pending":
            if now - state["sent"] < RESEND:
                return state, "throttled"
            return state | {"sent": now}, "resent"
        return {"created": now, "sent": now, "confirmed": None, "left": None}, "new" if state is None else "resubscribed"
    if event == "confirm":
        if phase == "pending":
            return state | {"confirmed": now}, "confirmed"
        return state, "already_confirmed" if phase == "confirmed" else "no_record"
    if event == "unsubscribe":
        if phase in ("pending", "confirmed"):
            return state | {"left": now}, "unsubscribed"
        return state, "already_unsubscribed" if phase == "left" else "no_record"
    return state, "ignored"


def _replay(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, added: str) -> DataFrame:
    """Rows of a key in order through ``step(state, row) -> (state, values)``; ``added`` are the new columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + added
    names = [c.strip().split(" ")[0] for c in added.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row[key] != current:
                    current, state = row[key], start()
                state, values = step(state, row)
                out.append(values)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def admission(events: DataFrame, limit: int, window: float, order: str = "event_id") -> DataFrame:
    """STM-03 as a batch: add ``allowed`` and ``wait`` (null if allowed); rows have key, ts (seconds) and ``order``."""

    def step(log, row):
        wait = admit(log, row["ts"], limit, window)
        return log, (wait is None, wait)

    return _replay(events, "key", ["ts", order], deque, step, "allowed boolean, wait double")


def lifecycles(events: DataFrame, order: str = "event_id") -> DataFrame:
    """STM-04 as a batch: add ``outcome``; rows have email, event, ts (seconds) and ``order``."""
    def step(state, row):
        state, outcome = lifecycle(state, row["event"], row["ts"])
        return state, (outcome,)

    return _replay(events, "email", ["ts", order], lambda: None, step, "outcome string")


def spend_cap(requests: DataFrame, cap: float, order: str = "event_id") -> DataFrame:
    """STM-08: admit while spent + held + worst case stays within the cap of a run.

    Rows of a run: kind reserve (``amount`` worst case), add (real cost of
    ``request``) or release.  Adds ``admitted`` (for reserves) and ``spent``.
    """
    def start():
        return {"spent": 0.0, "held": {}, "sum": 0.0}

    def step(s, row):
        request, amount = row["request"], float(row["amount"] or 0)
        if row["kind"] == "reserve":
            ok = s["spent"] + s["sum"] + amount <= cap + 1e-9
            if ok:
                s["sum"] += amount - s["held"].get(request, 0.0)
                s["held"][request] = amount
            return s, (ok, s["spent"])
        held = s["held"].pop(request, None)
        s["sum"] -= held or 0.0
        if row["kind"] == "add" and held is not None:
            s["spent"] += amount
        return s, (None, s["spent"])

    return _replay(requests, "run", ["ts", order], start, step, "admitted boolean, spent double")


def recipients(subscribers: DataFrame, sent: DataFrame, publish_id: str) -> DataFrame:
    """STM-06: confirmed addresses that have not been sent this publish; running it again sends to the rest alone."""
    done = sent.where(F.col("publish_id") == publish_id).select("email").distinct()
    return subscribers.where("confirmed_at IS NOT NULL AND unsubscribed_at IS NULL").join(done, "email", "left_anti")


def _times(ts: float) -> int:
    """Event time of a state's end, in the milliseconds that timers take; the next one, as ends are exclusive."""
    return int(ts * 1000) + 1


def admission_stream(events: DataFrame, limit: int, window: float, late: str = "1 hour") -> DataFrame:
    """STM-03 on a stream of (key, ts in seconds, event_id): the admitted times of a key are its state.

    A state ends by event time: once the watermark, ``late`` behind the newest
    event, has passed the last admitted time by the window.  A replayed log
    gives what the batch twin gives; rows older than the watermark are
    dropped, as Spark does.
    """

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else ())
        every = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = [(key[0], int(e), (w := admit(log, float(t), limit, window)) is None, w) for t, e in zip(every["ts"], every["event_id"])]
        state.update((list(log),))
        end = _times(log[-1] + window) if log else 0
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "wait"]).astype({"wait": "float64"})

    timed = events.withColumn("__time", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).withWatermark("__time", late)
    return timed.groupBy("key").applyInPandasWithState(
        step, "key long, event_id long, allowed boolean, wait double", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def lifecycle_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """STM-04, STM-05 on a stream of (email, event, ts in seconds, event_id): (email, event_id, outcome, ts), a row an event.

    The end of a record is a row of its own, without event_id and at the time
    of the end: ``expired`` for a pending one, ``purged`` for an unsubscribed
    one.  It comes once the watermark has passed the end, or with the event
    that finds the record outlived.
    """
    names = ("created", "sent", "confirmed", "left")

    def step(key, batches, state):
        record = dict(zip(names, state.get)) if state.exists else None
        out = []
        if state.hasTimedOut:
            kind, at = end_of(record)
            out.append((key[0], None, kind, at))
            state.remove()
        else:
            every = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for t, e, what in zip(every["ts"], every["event_id"], every["event"]):
                if (end := end_of(record)) and t > end[1]:
                    out.append((key[0], None, *end))
                record, outcome = lifecycle(record, what, float(t))
                out.append((key[0], int(e), outcome, float(t)))
            if record is None:
                if state.exists:
                    state.remove()
            else:
                state.update(tuple(record[n] for n in names))
                end = end_of(record)
                if end and _times(end[1]) > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(_times(end[1]))
        yield pd.DataFrame(out, columns=["email", "event_id", "outcome", "ts"]).astype({"event_id": "Int64"})

    timed = events.withColumn("__time", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).withWatermark("__time", late)
    return timed.groupBy("email").applyInPandasWithState(
        step, "email string, event_id long, outcome string, ts double", "created double, sent double, confirmed double, left double", "append", GroupStateTimeout.EventTimeTimeout
    )


def _spells(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """What each change of a record led to: email, outcome, ts, the next change's outcome (null for the last), ``end`` and ``outlived``."""
    changed = outcomes.where(F.col("outcome").isin("new", "resubscribed", "resent", "confirmed", "unsubscribed") & (F.col("ts") <= as_of))
    order = Window.partitionBy("email").orderBy("ts", "event_id")
    spells = changed.select("email", "outcome", "ts", F.lead("outcome").over(order).alias("next"))
    end = F.when(F.col("outcome") == "unsubscribed", F.col("ts") + RETENTION).when(F.col("outcome") != "confirmed", F.col("ts") + PENDING_TTL)
    # after the end of a record the address is new again
    outlived = F.when(F.col("next").isNull(), as_of > end).otherwise(F.col("next") == "new")
    return spells.withColumn("end", end).withColumn("outlived", F.coalesce(outlived, F.lit(False)))


def ends(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """STM-05: (email, outcome, ts): records that have ended before ``as_of`` (seconds), as ``lifecycle_stream`` tells them."""
    kind = F.when(F.col("outcome") == "unsubscribed", "purged").otherwise("expired")
    return _spells(outcomes, as_of).where("outlived").select("email", kind.alias("outcome"), F.col("end").alias("ts"))


def subscriber_counts(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """AGG-17: (state, n) as of a time in seconds, always of three states.

    ``outcomes`` are those of ``lifecycles`` or ``lifecycle_stream`` with ts.
    A pending record that has expired is not counted; an unsubscribed one
    still is when it has been purged.
    """
    spells = _spells(outcomes, as_of)
    state = F.when(F.col("outcome") == "confirmed", "confirmed").when(F.col("outcome") == "unsubscribed", "unsubscribed").otherwise("pending")
    last = F.col("next").isNull() & ~F.col("outlived")
    purged = F.col("outlived") & (F.col("outcome") == "unsubscribed")
    counted = spells.select(state.alias("state"), (last | purged).cast("long").alias("one")).groupBy("state").agg(F.sum("one").alias("n"))
    every = outcomes.sparkSession.createDataFrame([("confirmed",), ("pending",), ("unsubscribed",)], "state string")
    return every.join(counted, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
