"""Decontamination against brute-force edit distance."""

import random

import numpy as np
import pytest

from tessera.llm import decontam


def brute(item, words):
    """Fewest edits between the item and any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_fit_is_exact_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        words = [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        most = rng.randrange(0, 13)
        got = decontam.fit(np.array(item, np.uint64), np.array(words, np.uint64), most)
        want = brute(item, words)
        assert (got[0] if got else None) == (want if want <= most else None)


def edited(rng, words, vocabulary, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        what = rng.randrange(3)
        if what == 0:
            w[k] = rng.choice(vocabulary)
        elif what == 1:
            w.insert(k, rng.choice(vocabulary))
        elif len(w) > 1:
            del w[k]
    return w


def test_windows_are_as_long_as_items():
    for n in range(1, 400):
        size = decontam.class_of(n)
        assert size + decontam.stride_of(size) - 1 <= n and (n < 20 or size >= 0.6 * n) and (n < 60 or size >= 0.75 * n)


@pytest.mark.parametrize("n", [8, 10, 12, 16, 20, 30, 45, 59, 80, 100])
def test_the_walks_alone_find_nine_of_ten_at_the_most_edits(n):
    rng = random.Random(n)
    mixed = lambda words: np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    items = [[rng.randrange(1, 3000) for _ in range(n)] for _ in range(200)]
    index = decontam.Index([(k, mixed(w)) for k, w in enumerate(items)], 0.8, pieces_too=False)
    for edits, recall in ((0, 1.0), (decontam.edits_of(n, 0.8), 0.9)):
        docs = []
        for item in items:
            body = [rng.randrange(3000, 6000) for _ in range(90)]
            at = rng.randrange(40)
            docs.append(body[:at] + edited(rng, item, list(range(1, 3000)), edits) + body[at:])
        hits = {(d, k) for d, k, *_ in index.search(mixed([w for d in docs for w in d]), np.cumsum([len(d) for d in docs]))}
        assert len(hits & {(k, k) for k in range(200)}) >= recall * 200


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 3)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(14)]
    docs = spark.createDataFrame([(k, "a b " + t + " c") for k, t in items] + [(99, "nothing here")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.store_items(bench).count == 5
    got = decontam.contaminations(docs, bench)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got.collect()) == [(k, k, 0) for k in range(14)]
    assert [r.doc_id for r in decontam.clean_documents(docs, bench).collect()] == [99]


@pytest.mark.parametrize("share,recall", [(0.0, 1.0), (0.05, 0.99), (0.1, 0.97), (0.2, 0.9)])
def test_recall_on_edited_passages(share, recall):
    rng = random.Random(3)
    vocabulary = list(range(1, 3000)) + [5] * 600 + [6] * 300
    items = [(k, np.array([rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in range(60)]
    index = decontam.Index(items, 0.8)
    found = total = 0
    docs, truth = [], []
    for d in range(200):
        k = rng.randrange(len(items))
        body = [rng.choice(vocabulary) * 0x9E3779B97F4A7C15 % (1 << 64) for _ in range(200)]
        at = rng.randrange(200)
        vocab = [v * 0x9E3779B97F4A7C15 % (1 << 64) for v in vocabulary]
        docs.append(body[:at] + edited(rng, items[k][1].tolist(), vocab, int(share * len(items[k][1]))) + body[at:])
        truth.append(k)
    words = np.array([w for d in docs for w in d], np.uint64)
    hits = {(d, k): e for d, k, e, _ in index.search(words, np.cumsum([len(d) for d in docs]))}
    for d, k in enumerate(truth):
        want = brute(items[k][1].tolist(), docs[d])
        if want <= int(0.2 * len(items[k][1]) + 1e-9):
            total += 1
            found += (d, k) in hits
    assert total > 150 and found >= recall * total, (found, total)
    for (d, k), e in hits.items():
        assert brute(items[k][1].tolist(), docs[d]) <= e <= 0.2 * len(items[k][1])


def test_documents_and_items_of_every_kind(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today"
    texts = [
        None, "", " . ", "clean words only", item, f"before it {item.upper()}!! after", item.replace("quick", "swift"),
        item.replace("quick brown fox", "a b c d e f"), "short one", "x " * 5000 + item,
    ]
    rows = [(k, t, 1, "u") for k, t in enumerate(texts)] + [(None, item, 1, "u"), (4, item, 1, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int, words string")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (None, "Short, one.", 1)], "item_id long, text string, doc_id int")
    got = [(r.doc_id, r.item_id, r.edits) for r in decontam.contaminations(docs, items).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(4, 7, 0), (4, 7, 0), (5, 7, 0), (6, 7, 1), (9, 7, 0), (None, 7, 0), (8, None, 0)]
    assert sorted(got, key=key) == sorted(want, key=key)
    left = decontam.clean_documents(docs, items)
    assert left.columns == docs.columns
    # a null id does not save a row that holds an item
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, k) for k in (0, 1, 2, 3, 7)]
    twins = spark.createDataFrame([(1, item), (1, "clean"), (None, "clean"), (None, "clean")], "doc_id long, text string")
    assert sorted(r.text for r in decontam.clean_documents(twins, items).collect()) == ["clean"] * 3
    assert decontam.contaminations(docs.limit(0), items).collect() == []
    assert decontam.contaminations(docs, items.limit(0)).collect() == []
