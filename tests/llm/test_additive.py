"""The additive quality model: tables, held-out accuracy, odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import additive
from tessera.session import table

SF = "/root/testdata/sf0.01"


def made(n=3000, seed=0):
    """Labels that depend on a curve of one feature and on two others only together."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(additive.FEATURES)))
    margin = 6 * np.abs(x[:, 0] - 0.5) - 1.5 + 4 * np.where((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5), 1, -1)
    return x, (rng.random(n) < 1 / (1 + np.exp(-margin))).astype(float)


def test_a_score_is_the_sum_of_its_table_entries():
    x, y = made()
    model = additive.learn(x, y)
    for row in x[:20]:
        margin = model.base
        at = [int((e <= v).sum()) for e, v in zip(model.edges, row)]
        margin += sum(t[b] for t, b in zip(model.tables, at))
        margin += sum(t[model.coarse[i][at[i]], model.coarse[j][at[j]]] for (i, j), t in model.pairs.items())
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_pairs_are_found_and_needed():
    x, y = made()
    model = additive.learn(x, y)
    assert (3, 7) in model.pairs
    fresh, label = made(seed=1)
    right = ((model.score(fresh) >= 0.5) == (label > 0)).mean()
    alone = additive.Model(model.base, model.edges, model.tables)
    assert right > 0.9 and ((alone.score(fresh) >= 0.5) == (label > 0)).mean() < 0.7


def test_trees_cut_where_the_gain_is():
    g, n = np.array([-5.0, -5, 5, 5, 5, -5]), np.full(6, 10)
    values = additive.tree(g, n / 4, n)
    assert (np.sign(values) == [-1, -1, 1, 1, 1, -1]).all()
    assert np.allclose(additive.tree(g, n / 4, np.ones(6, int)), g.sum() / (n.sum() / 4 + additive.SMOOTHING))
    gain, grid = additive.pair_tree(np.array([[5.0, -5], [-5, 5]]), np.full((2, 2), 5.0), np.full((2, 2), 20))
    assert gain > 0 and (np.sign(grid) == [[1, -1], [-1, 1]]).all()


def test_measures():
    f = dict(zip(additive.FEATURES, additive.measure("A b b $$ |\nA b b $$ |\n12 x!".encode())))
    assert f["log_words"] == pytest.approx(np.log(13)) and f["stutters"] == pytest.approx(2 / 12)
    assert f["repeated_lines"] == pytest.approx(1 / 3) and f["bars"] == pytest.approx(2 / 12) and f["symbols"] == pytest.approx(4 / 12)
    assert f["distinct"] == pytest.approx(6 / 12) and f["top_word"] == pytest.approx(4 / 12) and f["digits"] == pytest.approx(2 / 12)
    for empty in (None, b"", b" \n\t"):
        assert not additive.measure(empty).any()
    assert np.isfinite(additive.measure(b"word " * 400_000)).all()


def test_rows_stay_and_held_out_labels_do_not_matter(spark):
    rows = [(k, "a clean line of words here " * 3 if k % 3 else "BUY!! NOW!! " * 9, 1) for k in range(90)]
    rows += [(None, "x y", 1), (1, None, 1), (1, "", 1), (5, "a clean line", 2), (5, "a clean line", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = [(k, int(k % 3 > 0)) for k in range(90)] + [(None, 1), (4, None), (7, 1), (7, 0)]
    turned = [(k, q if k is None or q is None or zlib.crc32(str(k).encode()) % 5 else 1 - q) for k, q in labels]
    got = []
    for said in (labels, turned):
        model = additive.fit(docs, spark.createDataFrame(said, "doc_id long, quality int"))
        got.append(additive.score(docs, model).collect())
    assert got[0] == got[1] and len(got[0]) == len(rows)
    for r, (doc_id, text, _) in zip(sorted(got[0], key=str), sorted(rows, key=str)):
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert {r.doc_id: r.held_out for r in got[0]} == {d: d is None or zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows}
    assert all(r.predicted == (r.doc_id % 3 > 0) for r in got[0] if r.doc_id is not None and r.doc_id > 5)


def test_no_labels_or_one_kind(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = additive.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in additive.score(docs, none).collect()] == [0.5, 0.5]
    one = additive.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.5 for r in additive.score(docs, one).collect())
    assert additive.score(docs.limit(0), one).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "a b") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    assert additive.examples(docs, labels, 20).count() == 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = additive.score(docs, additive.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    rows = scored.groupBy("quality").agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()
    right = {r.quality: r.right / r.n for r in rows}
    assert right[1] >= 0.97 and right[0] >= 0.75
