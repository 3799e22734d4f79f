"""Collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations
from tessera.session import BATCH_BYTES, arrow_batches


def plain(rows, min_count, top, absorbed=80):
    f, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            sizes[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {g: n for g, n in f.items() if len(g[1]) > 1 and n >= min_count}
    out = []
    for (lang, g), a in found.items():
        def around(longer):
            return any(longer[i : i + len(g)] == g for i in range(len(longer) - len(g) + 1))

        if any(x == lang and len(h) > len(g) and around(h) and 100 * n >= absorbed * a for (x, h), n in found.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, l, r, sizes[lang], score))
    ranked = []
    for lang in sizes:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, k, *x[1:]) for k, x in enumerate(mine, 1)]
    return sorted(ranked)


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "The", "of", "to", "New", "york", "état", "É", "x y", "a", "b-c", "\x1c", "zz"]
    weights = [9, 3, 6, 5, 4, 4, 3, 2, 1, 6, 1, 1, 0.2]
    fixed = ["in the United States of America", "as well as", "well as"]
    rows = []
    for k in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choices(words, weights)[0] for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for p in parts)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize("chunk,sieve", [(50, 27), (1 << 20, 6)])
def test_follows_the_definition(spark, chunk, sieve, monkeypatch):
    # with a sieve of 64 bits nearly every group passes, and results stay exact
    monkeypatch.setattr(collocations, "MAX_SIEVE", sieve)
    rows = texts(chunk) + [("en", None), ("en", ""), ("fr", " \n"), ("en", "a " * 500), ("en", "a " * 500)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n long").repartition(3)
    got = collocations.mine(frame, 4, 4, 80, 40, chunk).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == plain(rows, 4, 40)


def test_slices_of_a_long_text_join(spark, monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma.", "delta"]) for _ in range(3000))
    monkeypatch.setattr(collocations, "SLICE", 64)
    chunk = collocations._Chunk()
    chunk.add(text.encode())
    whole = collocations._Chunk()
    monkeypatch.setattr(collocations, "SLICE", 1 << 20)
    whole.add(text.encode())
    assert all(np.array_equal(a, b) for a, b in zip(chunk.row(0, "x", 0, 64)[2:], whole.row(0, "x", 0, 64)[2:]))
    assert b"".join(collocations._slices(b"ab cd " * 9)) == b"ab cd " * 9


def test_large_counts_are_exact(spark):
    level = spark.createDataFrame([([1, 2], 9_000_000_000_000_000_000, 2)], "words array<long>, f long, lang long")
    longer = spark.createDataFrame([([1, 2, 3], 7_200_000_000_000_000_000)], "words array<long>, f long")
    assert collocations._not_absorbed(level, longer, 80).count() == 0
    less = spark.createDataFrame([([3, 1, 2], 7_199_999_999_999_999_999)], "words array<long>, f long")
    assert collocations._not_absorbed(level, less, 80).count() == 1


def test_a_sieve_passes_what_was_put_in(spark):
    rng = np.random.default_rng(3)
    inside, outside = rng.integers(-(1 << 62), 1 << 62, (2, 5000, 3))
    found = spark.createDataFrame([tuple(map(int, r)) for r in inside], "w1 long, w2 long, w3 long")
    kept = collocations.sieve(found, 3)
    assert kept.passes(inside).all() and kept.passes(outside).mean() < 0.03
    assert not collocations.sieve(found.limit(0), 3).passes(outside).any()


def test_words_that_share_a_number_take_another_seed(spark):
    frame = spark.createDataFrame([("en", "alpha beta " * 9 + "gamma")], "lang string, text string")
    _, frequent = collocations._counted_words(frame, 4, 100, range(40), 3)
    assert sorted(r.phrase for r in frequent.collect()) == ["alpha", "beta"]
    # three words cannot have numbers of their own in one bit
    with pytest.raises(RuntimeError):
        collocations._counted_words(frame, 4, 100, range(2), 1)


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_a_task_holds_a_bounded_number_of_open_languages(spark):
    rows = [(f"l{k}", "a b c " * 20) for k in range(50)]
    frame = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert collocations.occurrences(frame, 100).selectExpr("sum(aggregate(counts, 0L, (x, y) -> x + y)) AS n").first().n == 3000


def test_workers_are_handed_batches_of_bounded_size(spark, monkeypatch):
    """A batch of a whole partition, of up to 10,000 texts or chunks, is what an executor's memory would have to hold besides its heap."""
    limits, written = [], collocations.written

    def seen(df, label, *options):
        limits.append(int(spark.conf.get(BATCH_BYTES)))
        return written(df, label, *options)

    was = spark.conf.get(BATCH_BYTES, None)
    monkeypatch.setattr(collocations, "written", seen)
    rows = spark.createDataFrame([("en", "a b c d " * 40)] * 30, "lang string, text string")
    got = collocations.mine(rows, min_count=2, chunk=50)
    assert len(limits) >= 8 and max(limits) <= collocations.BATCH_BYTES
    assert spark.conf.get(BATCH_BYTES, None) == was and got.count()
    with arrow_batches(spark, 10_000):
        sizes = spark.range(0, 100, 1, 1).selectExpr("repeat('x', 5000) AS t").mapInArrow(lambda it: (b.select([]).append_column("n", pa.array([b.num_rows] * b.num_rows)) for b in it), "n long")
        assert sizes.agg({"n": "max"}).first()[0] <= 3
