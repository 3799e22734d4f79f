"""Re-Pair files: exact round trips and random access."""

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import repair
from tessera.session import scratch


def check(docs, vocabulary=20):
    flat = np.array([x for d in docs for x in d], np.uint32)
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64)
    g = repair.compress(flat, ends, vocabulary, least=2)
    g["doc_id"], g["has_id"] = np.arange(len(docs)), np.ones(len(docs))
    out = io.BytesIO()
    assert repair.dump(g, out) == len(out.getvalue())
    g = repair.load(out.getvalue())
    assert repair.expand(g, g["symbols"]).tolist() == flat.tolist() == repair.expand_all(g).tolist()
    for k, d in enumerate(docs):
        assert repair.document(g, k).tolist() == list(d)
        assert repair.document(g, k, 1, 3).tolist() == list(d)[1:4]
    return g


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=40), min_size=1, max_size=6))
def test_round_trip(docs):
    check(docs)


def test_runs_and_copies_shrink():
    g = check([[1] * 1000, [1, 2, 3] * 200, [1]])
    assert len(g["symbols"]) < 250
    assert g["rule_length"].max() >= 8


@pytest.mark.parametrize("shard", [30, repair.SHARD_TOKENS])
def test_files_in_doc_id_order(spark, shard):
    texts = [None, "", "the cat sat", "the cat sat on the mat " * 20, "é日本", "a<|endoftext|>b", "x\ny"]
    rows = [(k if k else None, t, "clash") for k, t in enumerate(texts * 3)] + [(4, "again", "c"), (4, "again", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)
    manifest = repair.write_ids(docs, scratch(spark, "ids"), shard_tokens=shard)
    got = sorted(repair.read_ids(manifest).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(repair.TOKENIZER)
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((d or -1, crc(t)) for d, t, _ in rows)
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert repair.round_trip(docs.limit(0)).collect() == []
    wanted = spark.createDataFrame([(3, None, None), (3, 5, 7), (5, 1, 100), (77, 0, 1), (None, 0, 1)], "doc_id long, start long, count long")
    found = {(r.doc_id, r.start): r.ids for r in repair.lookup(manifest, wanted).collect()}
    ids = lambda k: [*library.encode(texts[k], add_special_tokens=False).ids, 2]
    assert found == {(3, None): ids(3), (3, 5): ids(3)[5:12], (5, 1): ids(5)[1:]}


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(5)
    flat = rng.zipf(1.3, 60_000).clip(1, 900).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(1, 60_000, 40), 60_000))
    g = repair.compress(flat, ends, 1000)
    assert repair.expand_all(g).tolist() == flat.tolist()
    joined = np.ones(len(g["symbols"]) - 1, bool)
    joined[np.cumsum(g["doc_symbols"])[:-1] - 1] = False
    pairs = list(zip(g["symbols"][:-1][joined].tolist(), g["symbols"][1:][joined].tolist()))
    most = max(pairs.count(p) for p in set(pairs[:2000]))
    assert most < repair.MIN_COUNT and len(g["symbols"]) < len(flat)


def test_symbols_beyond_two_bytes():
    g = repair.compress(np.arange(140_000) % 70_000, np.array([140_000]), 70_000, least=2)
    g["doc_id"], g["has_id"] = np.arange(1), np.ones(1)
    out = io.BytesIO()
    repair.dump(g, out)
    back = repair.load(out.getvalue())
    assert g["symbols"].tolist() == back["symbols"].tolist() and int(g["rule_left"].max()) > 1 << 16
    assert repair.expand_all(back).tolist() == (np.arange(140_000) % 70_000).tolist()


@pytest.mark.parametrize("bits", [5, 12])
def test_the_table_of_counts_decides_nothing(monkeypatch, bits):
    rng = np.random.default_rng(7)
    flat = rng.zipf(1.3, 100_000).clip(1, 900).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(1, 100_000, 40), 100_000))
    want = repair.compress(flat, ends, 1000)
    monkeypatch.setattr(repair, "_SLOT_BITS", bits)
    got = repair.compress(flat, ends, 1000)
    assert all(np.array_equal(got[k], want[k]) for k in want) and repair.expand_all(got).tolist() == flat.tolist()
