"""Near-duplicates by word shingles: pairs of texts whose shingle sets have a Jaccard similarity of 0.8, groups.

Candidates come from SimHash first: texts whose 64-bit fingerprints differ in
at most two bits meet through the index of ``simhash``.  At similarity 0.8
fingerprints differ in 10 bits on average, so pairs further apart come from
MinHash bands besides: texts that agree on all ``ROWS`` minima of one of
``BANDS`` bands meet, which at 0.8 misses a pair with probability
(1 - 0.8 ** ROWS) ** BANDS, 0.0004.  Every candidate of either kind is
verified on the whole shingle sets: texts of many repeated lines can have
equal fingerprints and little else in common.

Texts with equal sets are one node.  In a band that up to ``MAX_PAIRED`` nodes
share, all pairs are verified.  In larger ones the nodes that meet most others
are verified against all first; the pairs that are then still in different
groups are verified after that, unless their rare shingles rule them out, so
that no pair that could join two groups is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _held, _rows, simhash
from tessera.plans.components import connected_components
from tessera.session import written

SEED = 42
#: Least similarity in per cent.
SIMILARITY = 80
BANDS = 20
ROWS = 5
#: Nodes of one band that are paired at once; where more share one, its heads come first.
MAX_PAIRED = 16
HEADS = 4
#: Texts whose shingles a task holds at a time; results do not depend on it.
TEXTS = 256

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles, as in ``simhash.shingle_hashes``."""
    return np.unique(simhash.shingle_hashes(text, words).astype(np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One key a band, as signed longs; all texts without words agree."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 1 << 12):
        mixed = (hashes[k : k + (1 << 12), None] ^ _XOR) * _ODD
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(0))
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def node_of(hashes: np.ndarray) -> int:
    """Name of a shingle set, as a signed long."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``TEXTS`` rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            yield batch.slice(k, TEXTS)


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(place, doc_id, text_hash, fp, node, size, bands) for every row; fp is the SimHash as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _held.take("shingles", lambda: None)
        for batch in _few(batches):
            every = [simhash.shingle_hashes(t.as_py(), words) for t in batch.column("text")]
            sets = [np.unique(h.astype(np.uint64)) for h in every]
            columns = [
                batch.column("place"),
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(np.array([simhash.folded(h) for h in every], np.uint64).view(np.int64)),
                pa.array([node_of(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["place", "doc_id", "text_hash", "fp", "node", "size", "bands"])

    rows = docs.select("place", F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(each, "place long, doc_id long, text_hash long, fp long, node long, size long, bands array<long>")


def _sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the ``chosen`` nodes (node, text_hash), one row each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            sets = [shingles(t.as_py(), words) for t in batch.column("text")]
            columns = [batch.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    rows = docs.select("text", F.xxhash64("text").alias("text_hash")).join(chosen, "text_hash").select("node", "text")
    return rows.mapInArrow(each, "node long, shingles array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .withColumn("common", F.size(F.array_intersect("x", "y")))
    )
    return both.where(f"100 * common >= {SIMILARITY} * (size(x) + size(y) - common)").select("a", "b")


def _pairs(left: DataFrame, right: DataFrame, more: str) -> DataFrame:
    """Distinct (a, b), a < b, of rows of both that share a band and whose sizes allow the similarity."""
    near = f"100 * least(x.size, y.size) >= {SIMILARITY} * greatest(x.size, y.size)"
    met = left.alias("x").join(right.alias("y"), F.expr(f"x.band = y.band AND x.node <> y.node AND {near} AND {more}"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


#: Nodes that a rare shingle is in at most.
RARE = 16
#: Two nodes without a rare shingle in common have no more in common than either has in other shingles.
_CAP = f"100 * least(x.cap, y.cap) >= {SIMILARITY} * (x.size + y.size - least(x.cap, y.cap))"


def _rest(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of ``grouped`` (band, node, size, root, main) in different groups that may be similar.

    In a cloud of edited copies each edit makes shingles that few other copies
    have.  Pairs that share such a rare shingle meet by it, at most
    ``RARE ** 2 / 2`` a shingle; all others meet by their bands, but for those
    that their other shingles, ``cap``, rule out.
    """
    open_nodes = grouped.select("node", "size", "root").distinct()
    each = sets.join(open_nodes.select("node"), "node").select("node", F.explode("shingles").alias("shingle"))
    few = each.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE)
    rare = written(each.join(few, "shingle"), "rare")
    own = rare.groupBy("node").agg(F.count("*").alias("own"))
    capped = grouped.join(own, "node", "left").withColumn("cap", F.col("size") - F.coalesce("own", F.lit(0)))
    capped = written(capped.where(f"100 * cap >= {SIMILARITY} * size").drop("own"), "capped")
    # rows of the largest group of a band need not meet each other
    by_band = _pairs(capped.where("root <> main"), capped, f"x.root <> y.root AND {_CAP}")
    shared = rare.where("n > 1").join(open_nodes, "node").select(F.col("shingle").alias("band"), "node", "size", "root")
    return by_band.unionByName(_pairs(shared, shared, "x.node < y.node AND x.root <> y.root")).distinct()


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """(a, b), a < b, of nodes whose fingerprints (``prints`` has fp and node) are equal or differ in at most two bits.

    Nodes of one fingerprint meet its smallest node, which meets those of the
    fingerprints that ``simhash.link_edges`` links to it.
    """
    first = written(prints.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = prints.select("fp", "node").distinct().join(first, "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    at = (first.select(F.col("fp").alias(e), F.col("first").alias(n)) for e, n in (("a", "x"), ("b", "y")))
    near = simhash.link_edges(first.select("fp"))
    for ends, e in zip(at, "ab"):
        near = near.join(ends, e)
    met = equal.unionByName(near.select("x", "y")).where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, words: int, met: DataFrame) -> DataFrame:
    """(a, b) of similar nodes that connect what all similar candidates connect, those of ``met`` (a, b) and those of the bands of ``nodes``."""
    keys = nodes.select("node", "size", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    multi = written(keys.join(shared, "band"), "bands")
    few, many = multi.where(F.col("n") <= MAX_PAIRED), multi.where(F.col("n") > MAX_PAIRED)
    named = multi.select("node").unionByName(met.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    chosen = nodes.join(named, "node").select("node", "text_hash")
    sets = written(_sets(docs, chosen, words), "shingles")

    mass = many.groupBy("node").agg(F.sum("n").alias("mass"))
    # Spark limits each task's share of a band before bands meet
    order = Window.partitionBy("band").orderBy(F.desc("mass"), F.desc("node"))
    ranked = many.join(mass, "node").withColumn("place", F.row_number().over(order))
    heads = ranked.where(F.col("place") <= HEADS).select("band", "node", "size")
    first = met.unionByName(_pairs(few, few, "x.node < y.node")).unionByName(_pairs(many, heads, "true")).distinct()
    # read again below
    first = written(first, "first")
    linked = written(_verified(first, sets), "links")

    roots = connected_components(linked)
    grouped = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = grouped.groupBy("band", "root").agg(F.count("*").alias("part"))
    open_bands = parts.groupBy("band").agg(F.max(F.struct("part", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    grouped = written(grouped.join(open_bands, "band").select("band", "node", "size", "root", F.col("main.root").alias("main")), "open")
    rest = _rest(grouped, sets)
    rest = written(rest.join(first, ["a", "b"], "left_anti"), "rest")
    return linked.unionByName(_verified(rest, sets))


def _rooted(docs: DataFrame, words: int) -> DataFrame:
    """(place, doc_id, root) for every row of ``docs`` (place, doc_id, text); rows of one group share a root."""
    prints = written(_prints(docs, words), "prints")
    named = prints.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.max("size").alias("size"), F.max("bands").alias("bands"))
    nodes = written(named, "nodes")
    met = written(simhash_pairs(prints), "simhash")
    roots = connected_components(links(docs, nodes, words, met))
    joined = prints.select("place", "doc_id", "node").join(roots, "node", "left")
    return joined.select("place", "doc_id", F.coalesce("root", "node").alias("root"))


def groups(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and component_id for every row of ``docs`` (doc_id, text).

    A group is everything reachable over similar pairs; component_id is its
    smallest doc_id, null where all of its rows have a null doc_id.  Texts
    without words are one group.  Repeated rows give a row each.
    """
    rooted = written(_rooted(_rows.placed(docs.select("doc_id", "text"), "place"), words), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")


def representatives(docs: DataFrame, words: int) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group does.

    The row with the smallest doc_id stays, one without a doc_id only where no
    row of its group has one; of rows that repeat that doc_id the first does.
    All columns are kept.  Null, empty and blank texts are one group; no rows
    give none.
    """
    rows = _rows.placed(docs, "__place")
    rooted = _rooted(rows.select(F.col("__place").alias("place"), "doc_id", "text"), words)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "place")
    stay = rooted.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.place").alias("__place"))
    return rows.join(stay, "__place", "left_semi").select(docs.columns)
