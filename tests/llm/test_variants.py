"""Spelling variants against plain Python."""

import random
import re
import string
import zlib
from collections import Counter

import pytest

from tessera.llm import variants


def plain_words(rows, min_length=7, min_count=2, every=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=10):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def grown(rng, n, letters="abé", least=7, most=12):
    """Words at few edits of each other, with runs of one letter."""
    found = {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(n // 4)} | {"a" * 7, "a" * 8, "a" * 9}
    while len(found) < n:
        w = rng.choice(sorted(found))
        at = rng.randrange(len(w) + 1)
        w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]])
        if len(w) >= least:
            found.add(w)
    return sorted(found)


@pytest.mark.parametrize("most", [30, 20_000])
def test_every_pair_once(spark, most):
    words = grown(random.Random(most), 260)
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = [(r.word, r.near) for r in variants.near_words(frame, 7, most).collect()]
    want = {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_long_words_are_cut_into_spans():
    rng = random.Random(3)
    base = "".join(rng.choice(string.ascii_lowercase) for _ in range(3000))
    words = [base, base[:10] + "é" + base[11:], base[:2990] + "é" + base[2990:], base[:-1], base[1:], "x" + base]
    size = {}
    for w in words:
        for s in (len(w), len(w) - 1):
            size.setdefault(s, []).append(w)
    got = sorted(tuple(sorted(p)) for s, ws in size.items() for p in variants.near_pairs(ws, s, 0, s + 1))
    assert got == sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))


def test_acceptors_are_minimal():
    strings = sorted(a + b + "ing" for a in "abc" for b in "xyz")
    acceptor = variants.Acceptor(strings)
    assert len(acceptor.arcs) == 6 and sorted(acceptor.suffixes(acceptor.start)) == strings


def test_partitions_of_too_many_words_end_at_one_place(spark):
    words = ["aaaa" + x + y + "aaaa" for x in string.ascii_lowercase for y in string.ascii_lowercase]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    parts = variants.partitions(frame, 7, 40)
    assert max(r["count"] for r in parts.groupBy("key").count().collect()) <= 26 * 26
    got = variants.near_words(frame, 7, 40).count()
    assert got == 26 * 26 * 50


def test_groups_follow_the_definition(spark):
    rng = random.Random(9)
    words = grown(rng, 60)
    rows = [(None, "Ouvrages ouvrages OUVRAGES"), (1, None), (2, ""), (3, "a short one"), (4, "×÷" * 5), (5, "Ÿouvrages " * 3)]
    for k in range(60):
        rows.append((k, " ".join(rng.choices(words, [3 ** (i % 7) for i in range(60)], k=120)) + ";" + "Zebrafish-" * 3))
    rows += rows[6:9] + [(k, "kettlestone " * 40 + "kettlestones " * 3) for k in range(100, 110)] + [(200, "kettlestonesy kettlestonesy")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(frame).collect()}
    want = plain(plain_words(rows))
    assert got == want
    assert any(v[0] and v[0] != v[1] for v in want.values())


def test_empty_table(spark):
    assert variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_do_not_pass_whole_texts_or_one_partition(spark):
    frame = spark.createDataFrame([("ouvrages", 2)], "word string, n long")
    plan = variants.near_words(frame)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
