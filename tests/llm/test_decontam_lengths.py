"""Every item length at every offset, exact and with as many edits as it may have."""

import random

import numpy as np
import pytest

from tessera.llm import decontam


def hashed(words):
    return np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        what = rng.randrange(3)
        if what == 0:
            w[k] = rng.randrange(1, 3000)
        elif what == 1:
            w.insert(k, rng.randrange(1, 3000))
        elif len(w) > 1:
            del w[k]
    return w


@pytest.mark.parametrize("n", range(1, 31))
def test_no_item_is_missed_at_any_offset(n):
    rng = random.Random(n)
    most = int(0.2 * n + 1e-9)
    items = [[rng.randrange(1, 3000) for _ in range(n)] for _ in range(20)]
    index = decontam.Index([(k, hashed(w)) for k, w in enumerate(items)], 0.8)
    docs, truth = [], []
    for k, item in enumerate(items):
        for edits in {0, most}:
            for at in range(9):
                body = [rng.randrange(3000, 6000) for _ in range(40)]
                docs.append(body[:at] + edited(rng, item, edits) + body[at:])
                truth.append((k, edits))
    hits = {(d, k): e for d, k, e, _ in index.search(hashed([w for d in docs for w in d]), np.cumsum([len(d) for d in docs]))}
    missed = [(d, k) for d, (k, edits) in enumerate(truth) if hits.get((d, k), n) > edits]
    assert missed == []


@pytest.mark.parametrize("at", [0, 1, 2, 5])
def test_short_items_in_spark(spark, at):
    words = [f"i{k}" for k in range(20)]
    items = spark.createDataFrame([(n, " ".join(words[:n])) for n in range(1, 21)], "item_id long, text string")
    docs = spark.createDataFrame([(n, " ".join(["x"] * at + words[:n] + ["y"] * 4)) for n in range(1, 21)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminations(docs, items).where("edits = 0").collect()}
    assert got == {(d, n) for d in range(1, 21) for n in range(1, d + 1)}
