"""Queries without SQL against plain Python over the same rows, and publishes against what they must hold."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_states import plain_counts

from tessera import catalog
from tessera.operators import extract, filters, publish, records, resolve, verify
from tessera.queries.documents import _sub_events
from tessera.queries.functions import ZONE, today
from tessera.queries.listings import _candidates
from tessera.queries.records import COUNTED_AT, ENDED_BY
from tessera.streaming import states

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def replayed(spark):
    state, out = {}, {}
    for r in sorted(_sub_events(spark, SF).collect(), key=lambda r: (r.email, r.ts, r.event_id)):
        state[r.email], outcome = states.lifecycle(state.get(r.email), r.event, r.ts)
        out[r.event_id] = (r.email, outcome)
    return out


def test_subscriber_states_and_counts(spark):
    want = replayed(spark)
    got = {r.event_id: (r.email, r.outcome) for r in catalog.QUERIES["subscriber_states"](spark, SF).collect()}
    assert got == want
    events = [(r.email, r.event, r.ts, r.event_id) for r in _sub_events(spark, SF).collect()]
    counts = plain_counts(events, COUNTED_AT)
    assert {r.state: r.n for r in catalog.QUERIES["subscriber_counts"](spark, SF).collect()} == counts and counts["confirmed"]
    ends = catalog.QUERIES["subscriber_ends"](spark, SF).collect()
    assert {r.outcome for r in ends} == {"expired", "purged"} and all(r.ts < ENDED_BY for r in ends)


def test_eligible_entities(spark):
    got = catalog.QUERIES["eligible_entities"](spark, SF).collect()
    assert len(got) == 1500 and all(r.entities == extract.parse_entities(r.eligibility) for r in got)
    assert {e for r in got for e in r.entities} >= {"charitable-trust", "incorporated-society"}


def plain_survivors(rows, cluster):
    out = {}
    for r in rows:
        out.setdefault(cluster[r.pos], []).append(r)
    return out


def test_survivors(spark):
    rows = _candidates(spark, SF)
    plain = rows.collect()
    cluster = {r.pos: r.cluster for r in catalog.QUERIES["clusters"](spark, SF).collect()}
    got = {r.cluster: r for r in catalog.QUERIES["survivors"](spark, SF).collect()}
    groups = plain_survivors(plain, cluster)
    assert got.keys() == groups.keys() and any(len(g) > 2 for g in groups.values())
    for c, group in groups.items():
        kept = max(group, key=lambda r: (r.verified_at or "", not r.published, -r.pos))
        published = [r for r in group if r.published]
        assert len(published) <= 1
        named = published[0] if published else min(group, key=lambda r: (r.first_seen or "9999", r.id))
        row = got[c]
        assert (row.kept_pos, row.id, row.merged) == (kept.pos, named.id, len(group))
        assert (row.first_seen, row.last_seen) == (min(r.first_seen for r in group), max(r.last_seen for r in group))
        assert row.evidence_ids == list(dict.fromkeys(r.evidence_id for r in sorted(group, key=lambda r: r.pos)))


def test_publish_cumulative(spark):
    rows = _candidates(spark, SF)
    previous, fresh = rows.where("published"), rows.where("NOT published")
    got = catalog.QUERIES["publish_cumulative"](spark, SF).collect()
    ids = Counter(r.id for r in got)
    assert all(ids[r.id] == 1 for r in previous.select("id").collect())
    passed = {r.pos for r in fresh.where(filters.held_reason().isNull()).select("pos").collect()} | {r.pos for r in previous.select("pos").collect()}
    assert sum(r.merged for r in got) == len(passed) < rows.count() and {r.kept_pos for r in got} <= passed
    by_pos = {r.pos: r for r in rows.collect()}
    assert all(r.entities == extract.parse_entities(by_pos[r.kept_pos].eligibility) for r in got)
    assert {r.status for r in got} == {"live", "stale", "closed"}


def test_a_publish_is_blocked_forced_or_only_tried(spark, tmp_path):
    rows = _candidates(spark, SF).drop("published")
    previous = rows.where("pos % 4 = 0").withColumn("status", F.lit("live"))
    fresh = rows.where("pos % 4 <> 0 AND pos < 400")
    expected = spark.createDataFrame([("Funder 1",), ("Nobody",)], "name string")
    path = str(tmp_path / "pool")
    run = lambda **how: records.publish_pool(spark, path, 1, previous, fresh, expected, today(), ZONE, **how)
    with pytest.raises(records.PublishBlocked, match="^Nobody$"):
        run()
    assert not os.path.exists(f"{path}/_pointers") and os.path.exists(f"{path}/blocked/version=1")
    tried = run(dry_run=True)
    assert not os.path.exists(f"{path}/_pointers")
    counts = tried["counts"].first()
    assert counts.candidates == fresh.count() and counts.held == tried["held"].count() > 0
    assert counts.published_total == counts.live_total + counts.stale_total + counts.closed_total
    assert counts.published_total + counts.merges == previous.count() + counts.candidates - counts.held
    run(force=True)
    assert publish.current(spark, path, "pool").count() == counts.published_total
    assert {r.name: r.present for r in publish.current(spark, path, "must_appear").collect()} == {"Funder 1": True, "Nobody": False}


CLAIM = {
    "title": "River Fund", "funder": "Trust", "deadline_state": "dated", "deadline": "2031-05-09", "deadline_excerpt": "Applications close 9 May 2031",
    "eligibility_excerpt": "Open to local charities", "amount_excerpt": "Grants up to 5,000 dollars", "amount_min": None, "amount_max": 5000, "first_seen": "2030-01-01",
    "page_text": "River  Fund. Applications close 9 May 2031. Open to local charities. Grants up to 5,000 dollars. Apply any time of the year.",
}


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, (None, "River Fund", "dated", "2031-05-09", 5000)),
        ({"title": "River loan"}, ("not a grant", None, None, None, None)),
        ({"title": "Mountain Fund"}, ("title not found on page", None, None, None, None)),
        ({"title": "General"}, (None, "Trust grants", "dated", "2031-05-09", 5000)),
        ({"title": "GENERAL", "eligibility_excerpt": "never said on the page"}, ("nothing on the page supports the programme", None, None, None, None)),
        ({"deadline_excerpt": "never said on the page"}, (None, "River Fund", "not-stated", "TBC", 5000)),
        ({"deadline_excerpt": None, "deadline_state": "closed"}, ("deadline excerpt not found on page", None, None, None, None)),
        ({"deadline_excerpt": None, "eligibility_excerpt": None, "amount_excerpt": None}, ("nothing on the page supports the programme", None, None, None, None)),
        ({"deadline": "2031-05-10"}, ("day not stated", None, None, None, None)),
        ({"deadline": "soon"}, ("not a date", None, None, None, None)),
        ({"deadline": "2030-02-01", "deadline_excerpt": "Apply any time of the year", "deadline_state": "rolling"}, (None, "River Fund", "rolling-confirmed", "rolling", 5000)),
        ({"deadline_state": "rolling"}, (None, "River Fund", "not-stated", "TBC", 5000)),
        ({"deadline_state": "closed"}, (None, "River Fund", "closed", "2031-05-09", 5000)),
        ({"amount_max": 7000}, (None, "River Fund", "dated", "2031-05-09", None)),
        ({"amount_min": 9000}, (None, "River Fund", "dated", "2031-05-09", None)),
        ({"title": None, "page_text": None}, ("title not found on page", None, None, None, None)),
    ],
)
def test_claims(spark, change, want):
    row = CLAIM | change
    schema = ", ".join(f"{k} {'bigint' if k.startswith('amount_m') else 'string'}" for k in row)
    r = verify.check_claims(spark.createDataFrame([tuple(row.values())], schema), F.to_date(F.lit("2030-06-01"))).first()
    assert (r.reason, r.title, r.state, r.due, r.high) == want


def test_supplement_and_cases(spark):
    rows = spark.createDataFrame([("a", 1, "One two three"), ("b", 1, "x"), ("b", 2, "y"), ("b", 3, "z"), ("b", 4, "q")], "report string, pos long, title string")
    more = spark.createDataFrame([("a", 7, "three two one four"), ("a", 8, "two three five"), ("b", 9, "new"), ("c", 1, "only"), ("a", 9, None)], rows.schema)
    got = sorted((r.report, r.seq, r.pos, r.added) for r in resolve.supplement(rows, more).collect())
    assert got == [("a", 1, 1, False), ("a", 2, 8, True), ("a", 3, 9, True), ("b", 1, 1, False), ("b", 2, 2, False), ("b", 3, 3, False), ("b", 4, 4, False), ("c", 1, 1, True)]
