"""Keyed state: hand-written histories, and the stream against its batch twin."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.streaming import states

HOUR, DAY, START = 3600, 86_400, 1_700_000_000


def test_limiter_edges():
    log = deque()
    assert [states.admit(log, t, 2, 10) for t in (0, 1, 5, 10, 10.5, 11)] == [None, None, 5, None, 0.5, None]


@pytest.mark.parametrize(
    "history,outcomes",
    [
        ([("subscribe", 0), ("subscribe", HOUR - 1), ("subscribe", HOUR), ("confirm", HOUR + 1), ("subscribe", HOUR + 2)], ["new", "throttled", "resent", "confirmed", "already_confirmed"]),
        ([("subscribe", 0), ("confirm", 7 * DAY + 1)], ["new", "no_record"]),
        ([("subscribe", 0), ("unsubscribe", 5), ("unsubscribe", 6), ("subscribe", 7)], ["new", "unsubscribed", "already_unsubscribed", "resubscribed"]),
        ([("subscribe", 0), ("unsubscribe", 5), ("subscribe", 31 * DAY)], ["new", "unsubscribed", "new"]),
        ([("confirm", 0), ("unsubscribe", 1), ("x", 2)], ["no_record", "no_record", "ignored"]),
    ],
)
def test_lifecycle(history, outcomes):
    state, got = None, []
    for event, now in history:
        state, outcome = states.lifecycle(state, event, now)
        got.append(outcome)
    assert got == outcomes


def test_spend_cap_with_refunds(spark):
    rows = [
        ("r", 1.0, 1, "a", "reserve", 6.0), ("r", 2.0, 2, "b", "reserve", 5.0), ("r", 3.0, 3, "a", "add", 2.0), ("r", 4.0, 4, "b", "reserve", 5.0),
        ("r", 5.0, 5, "b", "release", None), ("r", 6.0, 6, "c", "reserve", 8.0), ("s", 1.0, 7, "a", "reserve", 11.0),
    ]
    frame = spark.createDataFrame(rows, "run string, ts double, event_id int, request string, kind string, amount double")
    got = {r.event_id: r.admitted for r in states.spend_cap(frame, 10.0).collect()}
    assert got == {1: True, 2: False, 3: None, 4: True, 5: None, 6: True, 7: False}


def drain(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture()
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_streams_equal_their_batch_twins(spark, one_partition, tmp_path):
    rng = random.Random(9)
    events = [(k, k % 5, f"a{k % 5}", rng.choice(["subscribe", "confirm", "unsubscribe"]), float(START + k * 100)) for k in range(120)]
    schema = "event_id long, key long, email string, event string, ts double"
    frame = spark.createDataFrame(events, schema)
    for part in range(3):  # files in the order of time
        frame.where(f"event_id >= {part * 40} AND event_id < {part * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch = {r.event_id: r.outcome for r in states.lifecycles(frame).collect()}
    live = {r.event_id: r.outcome for r in drain(spark, states.lifecycle_stream(stream()), tmp_path / "l", "life").collect()}
    assert live == batch
    limited = {r.event_id: r.allowed for r in states.admission(frame, 3, 2000.0).collect()}
    streamed = {r.event_id: r.allowed for r in drain(spark, states.admission_stream(stream(), 3, 2000.0), tmp_path / "a", "adm").collect()}
    assert streamed == limited


def test_the_stream_purges_what_its_time_has_outlived(spark, one_partition, tmp_path):
    schema = "event_id long, email string, event string, ts double"
    at = lambda days: START + days * DAY
    parts = [
        [(1, "pending", "subscribe", at(0.0)), (2, "kept", "subscribe", at(0.0)), (3, "kept", "confirm", at(0.1)), (4, "left", "subscribe", at(0.0)), (5, "left", "unsubscribe", at(0.2))],
        [(6, "clock", "subscribe", at(8.0))], [(7, "clock", "confirm", at(8.5))], [(8, "clock", "x", at(60.0))], [(9, "clock", "x", at(61.0))],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, states.lifecycle_stream(stream), tmp_path / "p", "purge")
    told = sorted((r.email, r.outcome, r.ts) for r in got.where("event_id IS NULL").collect())
    assert told == [("left", "purged", at(30.2)), ("pending", "expired", at(7.0))]
    same = states.ends(got.where("event_id IS NOT NULL"), F.lit(at(61.0)))
    assert sorted((r.email, r.outcome, r.ts) for r in same.collect()) == told
    counts = {r.state: r.n for r in states.subscriber_counts(got, F.lit(at(61.0))).collect()}
    assert counts == {"confirmed": 2, "pending": 0, "unsubscribed": 1}


def plain_counts(events, as_of):
    """The counts by a file of records that is purged whole before every change and before it is read."""
    records, purged = {}, 0

    def purge(now):
        nonlocal purged
        for email, r in list(records.items()):
            if r["left"] is not None:
                if now - r["left"] > 30 * DAY:
                    del records[email]
                    purged += 1
            elif r["confirmed"] is None and now - r["sent"] > 7 * DAY:
                del records[email]

    for email, event, now, _ in sorted(events, key=lambda e: (e[2], e[3])):
        if now > as_of:
            break
        purge(now)
        r = records.get(email)
        if event == "subscribe":
            if r is None or r["left"] is not None:
                records[email] = {"sent": now, "confirmed": None, "left": None}
            elif r["confirmed"] is None and now - r["sent"] >= HOUR:
                r["sent"] = now
        elif event == "confirm" and r and r["left"] is None and r["confirmed"] is None:
            r["confirmed"] = now
        elif event == "unsubscribe" and r and r["left"] is None:
            r["left"] = now
    purge(as_of)
    counts = {"confirmed": 0, "pending": 0, "unsubscribed": purged}
    for r in records.values():
        counts["unsubscribed" if r["left"] is not None else "confirmed" if r["confirmed"] is not None else "pending"] += 1
    return counts


def test_counts_as_of_any_day_equal_a_purged_file(spark, one_partition, tmp_path):
    rng = random.Random(6)
    events, now = [], float(START)
    for k in range(400):
        now += rng.choice([60.0, 4 * HOUR, DAY, 3 * DAY])
        events.append((f"a{rng.randrange(25)}", rng.choice(["subscribe", "subscribe", "confirm", "unsubscribe", "other"]), now, k))
    # on the very second of an end a record is still there
    events += [("edge", "subscribe", START + 0.0, 900), ("edge", "confirm", START + 7.0 * DAY, 901), ("edge", "unsubscribe", START + 8.0 * DAY, 902), ("edge", "subscribe", START + 38.0 * DAY, 903)]
    schema = "email string, event string, ts double, event_id long"
    frame = spark.createDataFrame(events, schema)
    outcomes = states.lifecycles(frame).cache()
    for as_of in [START - 1.0, START + 7.0 * DAY, START + 45.0 * DAY, now / 2 + START / 2, now, now + 8 * DAY, now + 400 * DAY]:
        got = {r.state: r.n for r in states.subscriber_counts(outcomes, F.lit(as_of)).collect()}
        assert got == plain_counts(events, as_of), as_of
    assert plain_counts(events, now)["unsubscribed"] > 5
    ordered = sorted(events, key=lambda e: e[2])
    for part in range(4):
        spark.createDataFrame(ordered[part * 101 : part * 101 + 101], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("clock", "other", now + 500 * DAY, 999)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("clock", "other", now + 501 * DAY, 1000)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = drain(spark, states.lifecycle_stream(stream), tmp_path / "c2", "ended")
    told = sorted((r.email, r.outcome, r.ts) for r in live.where("event_id IS NULL").collect())
    assert told == sorted((r.email, r.outcome, r.ts) for r in states.ends(outcomes, F.lit(now + 400 * DAY)).collect()) and len(told) > 20
    got = {r.state: r.n for r in states.subscriber_counts(live, F.lit(now)).collect()}
    assert got == plain_counts(events, now)


def test_spend_cap_against_a_replay(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(3)}", float(k), k, str(k), "reserve", float(rng.randrange(1, 40))) for k in range(300)]
    frame = spark.createDataFrame(rows, "run string, ts double, event_id int, request string, kind string, amount double")
    spent, want = {}, {}
    for run, _, k, _, _, amount in rows:
        want[k] = spent.get(run, 0) + amount <= 500
        spent[run] = spent.get(run, 0) + amount * want[k]
    assert {r.event_id: r.admitted for r in states.spend_cap(frame, 500.0).collect()} == want and not all(want.values())
