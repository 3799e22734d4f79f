"""Clusters and their links against a replay of all pairs in plain Python."""

import difflib
import os
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import resolve
from tessera.plans.forest import constrained_groups
from tessera.queries.listings import _candidates
from tessera.session import written

SF = "/root/testdata/sf0.001"
NAMES = "pos long, published boolean, id string, title string, funder string, dedupe_key string, source_url string, deadline string, amount_min long, amount_max long"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def all_pairs(rows):
    """(i, j, rule) in the order in which pairs are tried; key conflicts apart. ``rows``: dicts with normalised title, funder and url."""
    links, conflicts = [], []

    def pairs(key):
        blocks = defaultdict(list)
        for r in rows:
            if key(r):
                blocks[key(r)].append(r)
        for block in blocks.values():
            yield from combinations(block, 2)

    for a, b in pairs(lambda r: r["key"]):
        x, y = a["title"], b["title"]
        like = not x or not y or x in y or y in x or ratio(x, y) >= 0.6
        if not like:
            conflicts.append((a, b))
        if not (a["published"] and b["published"]) and like:
            links.append((a["pos"], b["pos"], 1))
    for a, b in pairs(lambda r: (r["funder"], r["title"]) if r["title"] else None):
        if not (a["published"] and b["published"]):
            links.append((a["pos"], b["pos"], 2))
    for a, b in pairs(lambda r: r["url"]):
        near = a["title"] and b["title"] and (a["title"] == b["title"] or ratio(a["title"], b["title"]) >= 0.9)
        facts = ("funder", "deadline", "amount_min", "amount_max")
        same = (a["amount_min"] is not None or a["amount_max"] is not None) and all(a[c] == b[c] for c in facts)
        if not (a["published"] and b["published"]) and (near or same):
            links.append((a["pos"], b["pos"], 3))
    return links, conflicts


def replay(rows, links):
    parent, holds = {r["pos"]: r["pos"] for r in rows}, {r["pos"]: r["published"] for r in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j, _ in links:
        a, b = find(i), find(j)
        if a != b and not (holds[a] and holds[b]):
            parent[b], holds[a] = a, holds[a] or holds[b]
    first = {}
    for k in sorted(parent):
        first.setdefault(find(k), k)
    return {k: first[find(k)] for k in parent}


def plain(rows):
    """The rows of a frame in order, normalised by the library's own column functions (held against SQL elsewhere)."""
    named = rows.select(
        "pos", "published", "deadline", "amount_min", "amount_max", F.coalesce("dedupe_key", F.lit("")).alias("key"),
        text.normalise_title("title").alias("title"), text.slug("funder").alias("funder"), text.normalise_url("source_url").alias("url"),
    )
    return [r.asDict() for r in named.orderBy("pos").collect()]


def made(spark, seed, n, first_published):
    rng = random.Random(seed)
    base = ["Community grant", "Community grants", "Sport fund", "Sports fund A", "Arts programme for young people", "Arts for young people", "ab", "ba", "", None]
    return spark.createDataFrame(
        [
            (k, k < n // 4 if first_published else rng.random() < 0.3, f"OPP-{k}", (rng.choice(base) or "") + rng.choice(["", "", " two", " 2024"]), f"F{rng.randrange(3)}",
             rng.choice(["k1", "k2", "k3", "", None]), rng.choice(["https://a.org/x", "http://www.a.org/x/", "https://b.org", "https://b.org/y?q=1", None]),
             rng.choice(["rolling", None]), rng.choice([None, 10]), rng.choice([None, 20, 30]))
            for k in range(n)
        ],
        NAMES,
    )


def held(spark, rows):
    links = written(resolve.edges(rows), "links")
    grouped = resolve.clusters(rows, links)
    got = {r.pos: r.cluster for r in grouped.collect()}
    frame = plain(rows)
    want, conflicts = all_pairs(frame)
    assert got == replay(frame, want)
    assert {(r.i, r.j, r.rule_no) for r in links.collect()} <= set(want) and links.count() <= len(want)
    parted = resolve.refused(links, grouped).collect()
    assert all(got[r.i] != got[r.j] for r in parted) and parted
    return frame, conflicts, got


@pytest.mark.parametrize("seed,first_published", [(1, True), (3, False)])
def test_groups_equal_the_replay_of_all_pairs(spark, seed, first_published):
    rows = made(spark, seed, 90, first_published)
    frame, conflicts, got = held(spark, rows)
    assert max(sum(r["published"] for r in frame if got[r["pos"]] == c) for c in set(got.values())) == 1
    told = {(r.dedupe_key, r.title): r.conflicts for r in resolve.key_conflicts(rows).collect()}
    first = {}
    for r in frame:
        first.setdefault((r["key"], r["title"]), r["pos"])
    unlike = defaultdict(int)
    for a, b in conflicts:
        if first[a["key"], a["title"]] == a["pos"] and first[b["key"], b["title"]] == b["pos"]:
            unlike[a["key"], a["title"]] += 1
            unlike[b["key"], b["title"]] += 1
    assert told == unlike


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_groups_of_the_tables_own_keys_and_urls(spark):
    _, _, got = held(spark, _candidates(spark, SF))
    assert len(set(got.values())) < len(got)


def test_a_url_of_a_third_of_all_rows_costs_a_link_a_row(spark):
    data = [(k, k % 50 == 0, f"O{k}", f"Fund {k % 7}", "F", f"key{k}", "https://hot.org/" if k % 3 == 0 else f"https://s{k}.org/", "rolling", None, None) for k in range(3000)]
    rows = spark.createDataFrame(data, NAMES)
    links = written(resolve.edges(rows), "links")
    assert links.count() < 2 * len(data)
    plan = resolve.edges(rows)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    frame = plain(rows)
    assert {r.pos: r.cluster for r in resolve.clusters(rows, links).collect()} == replay(frame, all_pairs(frame)[0])


def test_each_kind_of_link_is_a_job_of_its_own(spark, monkeypatch):
    """One plan of all links took more than a driver's memory at sf0.1; no job's plan joins more than a few tables."""
    joins = []

    def counted(df, label):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return written(df, label)

    monkeypatch.setattr(resolve, "written", counted)
    links = resolve.edges(made(spark, 1, 90, True))
    assert "Join" not in links._jdf.queryExecution().executedPlan().toString()
    assert max(joins) <= 12


@pytest.mark.parametrize("paired", [16, 0])
def test_similar_titles_of_small_blocks_equal_all_pairs(spark, monkeypatch, paired):
    monkeypatch.setattr(resolve, "MAX_PAIRED", paired)
    data = [(b, t) for b in ("x", "y") for t in ("grant", "grants", "sport grant", "a", "arts fund", "fund arts", "art fund", "ab")]
    got = sorted((r.block, r.a, r.b) for r in resolve.similar_titles(spark.createDataFrame(data, "block string, title string"), 0.6, True).collect())
    assert got == sorted((p, a, b) for p, a in data for q, b in data if p == q and a != b and (ratio(a, b) >= 0.6 or a in b or b in a))


def test_similar_titles_equal_all_pairs(spark):
    rng = random.Random(4)
    words = ["grant", "grants", "fund", "trust", "sport", "sports", "arts", "a", "of", "the", "12", "2024", "youth"]
    titles = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(160)} | {"a", "b", "aa", "ab", "ba", "abc", "cab"})
    data = [(b, t) for b in ("x", "y") for t in titles if b == "x" or rng.random() < 0.5]
    frame = spark.createDataFrame(data, "block string, title string")
    for least, contained in ((0.6, True), (0.9, False)):
        got = [(r.block, r.a, r.b) for r in resolve.similar_titles(frame, least, contained).collect()]
        want = {
            (p, a, b) for p, a in data for q, b in data
            if p == q and a != b and (ratio(a, b) >= least or contained and (a in b or b in a))
        }
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("paired", [16, 0])
def test_nested_pairs_are_all_pairs_of_a_key(spark, monkeypatch, paired):
    """Also rows whose title was first published, and pairs of titles of which both first rows are."""
    monkeypatch.setattr(resolve, "MAX_PAIRED", paired)
    rows = made(spark, 7, 90, True)
    frame = plain(rows)
    want = sorted(
        (a["pos"], b["pos"]) for a, b in combinations(frame, 2)
        if a["key"] and a["key"] == b["key"] and not (a["published"] and b["published"]) and (a["title"] in b["title"] or b["title"] in a["title"])
    )
    assert sorted((r.i, r.j) for r in resolve.nested_pairs(rows).collect()) == want


def test_unions_of_a_long_chain(spark):
    n = 400
    nodes = spark.createDataFrame([(k, k in (0, n - 1)) for k in range(n)], "node long, held boolean")
    order = list(range(n - 1))
    random.Random(5).shuffle(order)
    data = [(k, k + 1, order[k]) for k in range(n - 1)]
    links = spark.createDataFrame(data, "i long, j long, w long")
    got = {r.node: r["first"] for r in constrained_groups(nodes, links, ["w"]).collect()}
    rows = [{"pos": k, "published": k in (0, n - 1)} for k in range(n)]
    assert got == replay(rows, sorted(data, key=lambda e: e[2])) and len(set(got.values())) == 2


def test_no_rows(spark):
    rows = spark.createDataFrame([], NAMES)
    assert resolve.edges(rows).count() == 0 and resolve.clusters(rows, resolve.edges(rows)).count() == 0
