"""SimHash groups against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.plans import components
from tessera.plans.components import connected_components
from tessera.session import written


def plain_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """fp -> smallest reachable fp, all pairs compared."""
    todo, root = sorted(set(fps)), {}
    for x in todo:
        if x in root:
            continue
        stack = [x]
        while stack:
            y = stack.pop()
            if y in root:
                continue
            root[y] = x
            stack += [z for z in todo if z not in root and bin((y ^ z) & (1 << 64) - 1).count("1") <= 2]
    return root


TEXTS = [None, "", " \n", "one", "ONE", "a b", "a b c", "É é A\x0bb\x1cc d", "a a a a a a", "x " * 3000]


def test_fingerprints_follow_the_definition():
    assert [simhash.fingerprint(t) for t in TEXTS] == [plain_fingerprint(t) for t in TEXTS]


@pytest.mark.parametrize("max_paired", [2, 16])
def test_links_connect_what_all_pairs_connect(spark, max_paired):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.link_edges(frame, max_paired)
    assert edges.where("bit_count(a ^ b) > 2").count() == 0
    got = {r.node: r.root for r in connected_components(edges).collect()}
    want = groups(fps)
    assert {x: got.get(x, x) for x in fps} == want


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(50)]
    texts = list(TEXTS)
    for _ in range(12):
        w = [rng.choice(words) for _ in range(300)]
        for _ in range(4):
            v = list(w)
            v[rng.randrange(300)] = rng.choice(words)
            texts.append(" ".join(v))
    rows = [(k if k != 4 else None, t, 7) for k, t in enumerate(texts)] + [(0, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    fp = [plain_fingerprint(t) for _, t, _ in rows]
    root = groups(fp)
    least = {}
    for (doc, _, _), f in zip(rows, fp):
        if doc is not None:
            least[root[f]] = min(doc, least.get(root[f], doc))
    key = lambda x: (x[0] is None, x[0] or 0)
    want = [(doc, f"{f:016x}", least.get(root[f])) for (doc, _, _), f in zip(rows, fp)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    kept = simhash.representatives(docs, 3)
    assert kept.columns == docs.columns or set(kept.columns) == set(docs.columns)
    alone = [None] if root[fp[4]] not in least else []
    by_id = lambda k: (k is None, k or 0)
    assert sorted((r.doc_id for r in kept.collect()), key=by_id) == sorted([*least.values(), *alone], key=by_id)


def test_hashes_are_sparks(spark):
    row = spark.createDataFrame([("naïve 日本 words that are longer than thirty-two bytes",)], "s string").select(F.xxhash64("s")).first()
    assert row[0] % (1 << 64) == xxhash.xxh64("naïve 日本 words that are longer than thirty-two bytes".encode(), seed=42).intdigest()


def test_components_settle_without_a_round_to_see_it(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(components, "written", lambda df, label: stored.append(label) or written(df, label))
    stars = spark.createDataFrame([(9, 1), (8, 1), (7, 2), (7, 2), (3, 3)], "a long, b long")
    assert {tuple(r) for r in connected_components(stars).collect()} == {(9, 1), (8, 1), (1, 1), (7, 2), (2, 2)}
    assert len(stored) == 1
    chain = spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "a long, b long")
    assert {tuple(r) for r in connected_components(chain).collect()} == {(k, 1) for k in (1, 2, 3, 4)}
    assert len(stored) > 2


def test_a_star_step_reads_its_edges_twice(spark, tmp_path):
    spark.createDataFrame([(2, 1), (3, 2)], "u long, v long").write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    step = components._star(components._star(edges, True), False)
    assert {tuple(r) for r in step.collect()} == {(2, 1), (3, 1)}
    assert step._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 4
