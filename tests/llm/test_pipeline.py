"""The pipeline's stages on a small corpus, each against what it must do by definition."""

import os

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontam, quality, simhash


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    folder = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(f"item{k}" for k in range(30))

    def body(n=120):
        return " ".join(f"w{k}" for k in rng.integers(0, 4000, n))

    texts, kinds = [], []
    for k in range(160):
        kind = ("clean", "clean", "toxic", "short", "copy", "leak")[k % 6]
        text = body() if kind != "short" else body(9)
        if kind == "toxic":
            text += " moron"
        if kind == "leak":
            text += " " + item
        if kind == "copy":
            text = texts[k - 4]  # a clean one
        texts.append(text)
        kinds.append(kind)
    rows = [(k, t, "en", f"s{k % 3}", len(t), "x") for k, t in enumerate(texts)] + [(1000, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(k, 1, int(kind == "toxic")) for k, kind in enumerate(kinds)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, kinds


def test_each_stage(spark, sf_dir):
    folder, kinds = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    of = lambda *names: {k for k, kind in enumerate(kinds) if kind in names}
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        left.append(ids(docs))
    assert left[0] == of("clean", "toxic", "copy", "leak")
    assert left[1] == of("clean", "copy", "leak")
    assert left[2] == of("clean", "leak")
    assert left[3] == of("clean")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert ids(packed) == of("clean")
    assert ids(corpus_pipeline.run(spark, folder)) == of("clean")


def test_empty_documents(spark, sf_dir):
    folder, _ = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []
        if "piece" not in out.columns:
            assert out.columns == docs.columns


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "toxicity", "SimHash near-dedup", "benchmark decontamination", "best-fit packing",
    ]
    assert quality.POLICIES["v1"] and simhash.BITS == 2 and decontam.SIMILARITY == 0.8 and os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
