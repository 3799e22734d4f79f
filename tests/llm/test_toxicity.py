"""Nearest examples against brute force, and held-out accuracy."""

import math
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import toxicity

SF = "/root/testdata/sf0.1"


def plain_vectors(texts, toxic):
    """TF-IDF of whole texts in plain Python: every word and word beginning, dense."""
    bags = []
    for t in texts:
        found = Counter()
        for w in re.findall(r"\w+", (t or "").lower()):
            found.update([w, *(w[:n] + "*" for n in toxicity.PREFIXES if len(w) >= n)])
        bags.append(found)
    names = sorted(set().union(*bags))
    n, base = len(texts), sum(toxic) / len(texts)
    weight = []
    for f in names:
        df = sum(f in b for b in bags)
        bad = sum(t for b, t in zip(bags, toxic) if f in b)
        found = 0.0
        if bad / df > base:
            found = bad * math.log(bad / df / base) + ((df - bad) * math.log((1 - bad / df) / (1 - base)) if df > bad else 0.0)
        weight.append(math.log((1 + n) / (1 + df)) * (1 + max(0.0, found - math.log(len(names)))))
    dense = np.array([[(1 + math.log(b[f])) * w if f in b else 0.0 for f, w in zip(names, weight)] for b in bags])
    return dense / np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-300)


def model_of(texts, toxic, ids):
    bags = [toxicity.bag(t) for t in texts]
    return toxicity.Model(
        np.array(ids), np.array(toxic, float), np.repeat(np.arange(len(texts)), [len(a) for a, _ in bags]),
        np.concatenate([a for a, _ in bags]), np.concatenate([n for _, n in bags]),
    )


@pytest.mark.parametrize("share", [0.0, 0.05, 0.3])
def test_nearest_is_exact_over_whole_texts(monkeypatch, share):
    monkeypatch.setattr(toxicity, "LONG_SHARE", share)
    rng = np.random.default_rng(4)
    texts, toxic = [], []
    for k in range(700):
        low = 40 * (k % 5)
        text = " ".join(f"word{j}xy{j % 7}" for j in rng.integers(low, low + 90, rng.integers(1, 120)))
        toxic.append(int(k % 9 == 0))
        texts.append(text + " moron" * (k % 9 == 0))
    texts[9] = texts[600] = texts[5]
    texts[3] = ""
    ids = [10 * k + 3 for k in range(700)]
    model = model_of(texts, toxic, ids)
    assert sorted(model.ids.tolist()) == ids and model.size.sum() == sum(len(toxicity.bag(t)[0]) for t in texts)
    dense = plain_vectors(texts, toxic)
    for k in (3, 5, 9, 600, *range(0, 700, 37)):
        cosine = dense @ dense[k]
        cosine[k] = -1
        want = np.sort(cosine)[::-1][: toxicity.NEIGHBOURS]
        at, got = model.nearest(*model.vector(texts[k]), ids[k])
        assert np.allclose(got, want[want > 1e-6], atol=2e-6)
        own = cosine[(model.ids[at] - 3) // 10]
        assert np.allclose(own, got, atol=2e-6) and ids[k] not in model.ids[at]


def test_texts_are_scored_together_and_each_as_alone(monkeypatch):
    rng = np.random.default_rng(6)
    # one of "part0" to "part4" is in a fifth of the texts, which was too few for a long list
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 900, 30)) + f" part{k % 5}" + " moron" * (k % 7 == 0) for k in range(400)]
    model = model_of(texts, [int(k % 7 == 0) for k in range(400)], list(range(400)))
    model._long()
    asked = [*texts, None, "", "unheard of", texts[8] * 40]
    own = [*range(400), None, 8, 9, None]
    alone = [model.raw(t, k) for t, k in zip(asked, own)]
    walked, passes, spread, nearest = [], [], toxicity.spread, model.all_nearest
    monkeypatch.setattr(toxicity, "spread", lambda start, size: walked.extend(size.tolist()) or spread(start, size))
    monkeypatch.setattr(model, "all_nearest", lambda *a: passes.append(1) or nearest(*a))
    value, near, cosine = model.scores(asked, own)
    assert len(passes) == -(-len(asked) // toxicity.TEXTS) and 0 < max(walked) <= max(toxicity.BLOCK, toxicity.LONG_SHARE * 400)
    monkeypatch.setattr(toxicity, "TEXT_CHARS", 500)
    again = model.scores(asked, own)
    for k, one in enumerate(alone):
        assert value[k] == again[0][k] == one[0]
        assert near[k].tolist() == again[1][k].tolist() == one[1].tolist() and cosine[k].tolist() == one[2].tolist()
    assert model.scores([], [])[0].tolist() == []


@pytest.fixture(scope="module")
def corpus(spark):
    rows, rng = [], np.random.default_rng(8)
    for k in range(400):
        bad = k % 5 == 0
        rows.append((k, " ".join(f"w{j}" for j in rng.integers(0, 90, 40)) + (" You MORON!" if bad else ""), int(bad)))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1, b) for k, _, b in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_scores_votes_and_evidence(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    assert sorted(model.ids.tolist()) == sorted(r.doc_id for r in toxicity.examples(docs, labels).collect())
    more = docs.unionByName(spark.createDataFrame([(None, None, "x"), (900, "", "x"), (901, "moron " * 9000, "x"), (901, "moron " * 9000, "x")], docs.schema))
    got = toxicity.score(more, model).collect()
    assert len(got) == 404
    for r in got:
        want = r.doc_id is not None and (r.doc_id > 900 or (r.doc_id < 400 and r.doc_id % 5 == 0))
        assert r.predicted == int(want) and 0 <= r.score <= 1
        assert (len(r.evidence) == toxicity.NEIGHBOURS) == (r.doc_id is not None and r.doc_id != 900) and r.doc_id not in r.evidence
        assert r.cosine == sorted(r.cosine, reverse=True)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    used = {e for r in got for e in r.evidence}
    assert not used & {r.doc_id for r in got if r.held_out}
    kept = toxicity.clean_documents(more, model)
    assert kept.columns == docs.columns and kept.count() == 322
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_without_labels_of_both_kinds(corpus):
    docs, labels = corpus
    for some in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit(docs, some)
        assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}


def test_bound_on_examples(corpus):
    docs, labels = corpus
    twice = docs.unionByName(docs)
    assert toxicity.examples(twice, labels, 50).count() == 50
    model = toxicity.fit(twice, labels, 50, 900)
    assert 0 < model.size.sum() <= 900 and len(model.ids) < 50


def test_the_own_label_does_not_enter(corpus):
    docs, labels = corpus
    some = [r.doc_id for r in toxicity.examples(docs, labels).limit(3).collect()]
    model = toxicity.fit(docs, labels)
    for k in some:
        text = docs.where(f"doc_id = {k}").first().text
        was = model.raw(text, k)[0]
        model.toxic[model.at_id[k]] = 1 - model.toxic[model.at_id[k]]
        assert model.raw(text, k)[0] == was


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_recall_in_every_language(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert len(model.ids) == toxicity.examples(docs, labels).count()
    tested = docs.where(toxicity.held_out()).join(labels, "doc_id").select("doc_id", "text", "lang", "toxic")
    got = toxicity.score(tested, model).join(tested.drop("text"), "doc_id").collect()
    by = {}
    for r in got:
        by.setdefault((r.lang, r.toxic), []).append(r.predicted)
    assert len(by) == 8
    for (lang, toxic), predicted in by.items():
        if toxic:
            assert len(predicted) < 10 or sum(predicted) >= 0.9 * len(predicted), lang
        else:
            assert sum(predicted) <= 0.1 * len(predicted), lang
    clean = [p for (_, toxic), ps in by.items() if not toxic for p in ps]
    assert sum(clean) <= 0.02 * len(clean)


def test_the_index_is_made_in_little_memory():
    rng = np.random.default_rng(3)
    term = np.sort(rng.integers(0, 1 << 12, (400, 1000)).astype(np.uint64), 1).ravel()
    doc, tf = np.repeat(np.arange(400, dtype=np.int32), 1000), rng.integers(1, 5, 400_000).astype(np.int32)
    tracemalloc.start()
    model = toxicity.Model(np.arange(400), (np.arange(400) % 7 == 0).astype(float), doc, term, tf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # bytes a posting beside those handed over
    assert len(model.post_doc) == len(term) and peak < 40 * len(term), peak
