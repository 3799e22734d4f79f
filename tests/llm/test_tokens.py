"""Token counting, the shared encoder and packing against the library on whole texts."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import _tokens, packing, tokencount

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", " ", "\n", "  a  b ", "a\n\n b\tc", "x\x1cy z", "a<|endoftext|>b c", "it's we'll 'tis", "\0a b", "É a ́b Σς ΑΣ",
    "a,b c. d!!! e***", "日本語 テスト、です", "😀 😀😀, x", "l'eau, d'été.\r\nx", "word " * 300, "x" * 5000, "a.\nB c,\nd",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 3 else None, t, "extra", k) for k, t in enumerate(ODD)] + [(5, ODD[5], "twice", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab'sZ É́,.*\n\t \x1c0日<|>", max_size=40), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_the_whole_text(name, texts):
    e = _tokens.encoder(public_tokenizers.path(name))
    for first, end, ids, n in e.batches(texts):
        got = np.split(ids, np.cumsum(n)[:-1])
        assert [g.tolist() for g in got] == [e.library.encode(t, add_special_tokens=False).ids for t in texts[first:end]]


@pytest.mark.parametrize("chunk,overlap", [(200_000, 2_000), (50, 4), (40, 20)])
def test_counts_are_the_librarys(spark, docs, chunk, overlap):
    library = Tokenizer.from_file(tokencount.TOKENIZER)
    got = tokencount.count_tokens(docs, chunk_chars=chunk, overlap_chars=overlap).collect()
    want = [
        (r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
        for r in docs.collect()
    ]
    key = lambda x: (x[0] is None, x)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_the_query_splices_texts_and_counts_like_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = tokencount.count_tokens(docs).collect()
    library = Tokenizer.from_file(tokencount.TOKENIZER)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    spliced = [r for r in got if r.n_chunks > 1]
    assert all((r.n_chunks > 1) == (len(texts[r.doc_id]) > tokencount.CHUNK_CHARS) for r in got)
    assert sum(len(texts[r.doc_id]) for r in spliced) >= 0.2 * sum(map(len, texts.values()))


def test_overlaps_without_a_common_boundary_are_widened(spark):
    rows = [(1, "x" * 900 + " y" * 50), (2, "ab cd " * 200), (3, "\t".join("pq" for _ in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(tokencount.TOKENIZER)
    got = {r.doc_id: (r.n_tokens, r.n_chunks) for r in tokencount.count_tokens(docs, chunk_chars=100, overlap_chars=8).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in rows}
    assert got[2][1] == 12 and got[1][1] < 10 and got[3][1] == 1


def test_other_vocabularies_are_refused_for_chunks(docs):
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.count_tokens(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def test_counts_of_an_empty_table(docs):
    assert tokencount.count_tokens(docs.limit(0)).collect() == []


def test_packing_keeps_every_id_and_every_capacity(docs):
    library = Tokenizer.from_file(packing.TOKENIZER)
    rows = packing.pack_documents(docs).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [
            (r.doc_id, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))
            for p, s in enumerate(range(0, len(ids), 2048))
        ]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_respects_documents_and_attention(score):
    lengths = np.random.default_rng(3).integers(1, 400, 2000)
    sequence, offset = packing.best_fit(lengths, 512, 4, 18, (1.0, 0.2, 0.2), score)
    docs, tokens = np.bincount(sequence), np.bincount(sequence, weights=lengths)
    cost = np.bincount(sequence, weights=packing.tiles(lengths))
    assert docs.max() == 4 and tokens.max() == 512 and cost.max() <= 18
    order = np.argsort(offset, kind="stable")
    for s in range(sequence.max() + 1):
        own = order[sequence[order] == s]
        assert offset[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist()


def test_best_fit_chooses_like_a_plain_search():
    lengths = np.random.default_rng(9).integers(1, 600, 400)
    full, weight = np.array([1024.0, 5, 70]), np.array([1.0, 0.3, 0.3])
    got, _ = packing.best_fit(lengths, 1024, 5, 70, tuple(weight))
    left, total = [], np.zeros(3)
    for n in sorted(lengths.tolist(), reverse=True):
        demand = np.array([n, 1, packing.tiles(n)])
        room = [(float(((r - demand) ** 2 * weight / full**2).sum()), k) for k, r in enumerate(left) if (r >= demand).all()]
        if room:
            left[min(room)[1]] -= demand
        else:
            left.append(full - demand)
        total += demand
    assert abs(got.max() + 1 - len(left)) <= 1
    assert len(left) >= (total / full).max()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_capacities_bind_and_cost_no_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    packed = packing.pack_documents(docs)
    left = packing.residuals(packed).collect()
    tokens = sum(r.length for r in packed.select("length").collect())
    assert len(left) <= 1.01 * -(-tokens // 2048) + 1
    assert min(min(r.tokens_left, r.docs_left, r.cost_left) for r in left) >= 0
    assert any(r.cost_left == 0 and r.tokens_left > 0 for r in left)
    # 1,900 tokens are 225 tiles, so 32 pieces of a tile each join them; the others go 64 to a sequence
    sequence, _ = packing.best_fit(np.array([1900] * 5 + [2] * 400))
    assert np.bincount(sequence).tolist() == [33, 33, 33, 33, 33, 64, 64, 64, 48]


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(None, 0, 0, 700, 5, "x")] * 3000
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id string")
    packed = packing.pack(pieces, shard_pieces=500)
    by = packed.groupBy("sequence_id").count().collect()
    assert packed.count() == 3000 and len({r.sequence_id >> 32 for r in by}) == 6 and max(r["count"] for r in by) == 2


def test_best_fit_is_close_to_the_bound():
    lengths = np.minimum(2048, np.random.default_rng(1).lognormal(5.6, 1.1, 5000).astype(int) + 1)
    sequence, _ = packing.best_fit(lengths)
    assert sequence.max() + 1 <= -(-lengths.sum() // 2048) + 3
