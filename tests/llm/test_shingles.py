"""Shingle groups against brute force on edited copies."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import shingles, simhash
from tessera.plans import components
from tessera.session import written


def plain(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def roots(sets):
    """Smallest index reachable over similar pairs, all pairs compared."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        what = rng.randrange(3)
        if what == 0:
            w[k] = f"n{rng.randrange(10**6)}"
        elif what == 1:
            w.insert(k, f"n{rng.randrange(10**6)}")
        else:
            del w[k]
    return w


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = []
    # lengths and edits at similarities from about 0.7 to 0.98
    for n, edits in ((100, 1), (100, 2), (200, 3), (200, 5), (500, 5), (500, 11), (1000, 10), (1000, 20)):
        for _ in range(6):
            w = [f"w{rng.randrange(4000)}" for _ in range(n)]
            out += [w, edited(rng, w, edits)]
    # one large group, whose copies resemble the original more than each other, and texts that share half of theirs
    w = [f"w{rng.randrange(4000)}" for _ in range(300)]
    out += [w] + [edited(rng, w, rng.randrange(1, 6)) for _ in range(50)]
    out += [w[:150] + [f"w{rng.randrange(4000)}" for _ in range(150)] for _ in range(30)]
    out = [" ".join(x) for x in out]
    rng.shuffle(out)
    return out + [None, "", " \n", "one", "ONE", "a b c d", "a b c e"]


@pytest.mark.parametrize("max_paired", [2, 16])
def test_groups_against_brute_force(spark, texts, max_paired, monkeypatch):
    monkeypatch.setattr(shingles, "MAX_PAIRED", max_paired)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in shingles.groups(docs, 5).collect()}
    assert got == dict(enumerate(roots([plain(t) for t in texts])))


def test_stage_drops_edited_copies(spark, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x"), (3, texts[3], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    root = roots([plain(t) for t in texts])
    # one row a group: neither the copy without an id nor the row that repeats 3 stays
    assert sorted(r.doc_id for r in kept.collect()) == [k for k in range(len(texts)) if root[k] == k]
    nameless = spark.createDataFrame([(None, texts[0], "x"), (None, texts[0], "y"), (None, texts[1], "z")], docs.schema)
    assert corpus_pipeline.near_dedup(spark, nameless, "").count() == len({root[0], root[1]})
    assert shingles.representatives(docs.limit(0), 5).collect() == []


def test_recall_of_bands_at_the_limit():
    rng = random.Random(9)
    found = total = 0
    for n, edits in ((100, 2), (200, 4), (500, 10), (1000, 21)):
        for _ in range(400):
            w = [f"w{rng.randrange(4000)}" for _ in range(n)]
            a, b = (shingles.shingles(" ".join(x), 5) for x in (w, edited(rng, w, edits)))
            common = len(set(a.tolist()) & set(b.tolist()))
            share = common / (len(a) + len(b) - common)
            if 0.8 <= share < 0.86:
                total += 1
                found += bool(set(shingles.bands(a)) & set(shingles.bands(b)))
    assert total > 400 and found >= 0.998 * total, (found, total)


def test_simhash_finds_candidates_and_shingles_decide(spark, monkeypatch):
    """Without bands that meet, close fingerprints alone link copies with an edit; equal ones of unlike texts link nothing."""
    monkeypatch.setattr(shingles, "bands", lambda hashes: [])
    long = " ".join(f"w{k}" for k in range(3000))
    repeated = ["again " * 2000 + " ".join(f"{x}{k}" for k in range(40)) for x in "xy"]
    texts = [long, long + " end", long.replace("w1500 ", "v "), *repeated]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 2 for p in prints[1:3]) and (prints[3] ^ prints[4]).bit_count() <= 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.representatives(docs, 5).collect()) == [0, 3, 4]


def test_candidates_are_found_once(spark, texts, monkeypatch):
    plans = []

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")))
        return written(df, label)

    monkeypatch.setattr(shingles, "written", noted)
    monkeypatch.setattr(components, "written", noted)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert shingles.groups(docs, 5).count() == len(texts)
    # what a job reads is what its plan costs the driver
    assert max(n for _, n in plans) <= 10, plans


def test_a_task_holds_the_shingles_of_few_texts(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "place long, doc_id long, text string").coalesce(1)
    want = {tuple(r[:6]) for r in shingles._prints(docs.withColumn("text_hash", F.xxhash64("text")), 5).collect()}
    monkeypatch.setattr(shingles, "TEXTS", 3)
    assert {tuple(r[:6]) for r in shingles._prints(docs, 5).collect()} == want and len(want) == len(texts)
    sizes = [b.num_rows for b in shingles._few([pa.RecordBatch.from_pydict({"text": texts[:7]})])]
    assert sizes == [3, 3, 1]
