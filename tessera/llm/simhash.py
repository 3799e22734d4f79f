"""SimHash near-duplicates: fingerprints, links at a small Hamming distance, groups.

Links are found with deletion-variant signatures.  A 64-bit fingerprint is cut
into two 32-bit segments; if two fingerprints differ in at most two bits, one
of the segments differs in at most one.  Every fingerprint is therefore
indexed under each segment with each single bit left out (a wildcard), equal
signatures are joined and candidates verified on all 64 bits.  A signature
that many fingerprints share would pair them all, so those fingerprints are
linked another way, as exactly: two fingerprints differ in at most two bits
if and only if some fingerprint is at most one bit from both, so each is
listed under itself and its 64 one-bit neighbours, and the at most 65 under
one entry are chained to the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _rows
from tessera.plans.components import connected_components
from tessera.session import written

SEED = 42
SHINGLE_WORDS = 3
BITS = 2
#: Fingerprints under one signature that are paired; where more share one, the neighbour index links them.
MAX_PAIRED = 16


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every occurrence of a whole text's shingles.

    A-Z are lower-cased, words are maximal runs without U+0020 and
    U+0009..U+000D.  A text of fewer words is one shingle; a text without
    words has none.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, ">u8")
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")


def folded(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes: the bits set in over half of them; 0 without any."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text; 0 without words."""
    return folded(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, fp long")


def _signatures(fps: DataFrame) -> DataFrame:
    """(sig, fp): 64 signatures a fingerprint, 6 bits for segment and wildcard before the 32 of the segment."""
    # sig = k << 32 | (segment with bit k % 32 cleared)
    sig = F.expr(
        """transform(sequence(0, 63), k -> shiftleft(cast(k AS bigint), 32)
             | (shiftrightunsigned(fp, 32 * (k DIV 32)) & 4294967295L & ~shiftleft(1L, k % 32)))"""
    )
    return fps.select("fp", F.explode(sig).alias("sig"))


def link_edges(fps: DataFrame, max_paired: int = MAX_PAIRED) -> DataFrame:
    """(a, b) pairs of distinct fingerprints at 1 or 2 differing bits that connect what all such pairs connect.

    ``fps`` holds distinct longs.  Every pair under a signature of up to
    ``max_paired`` fingerprints is verified and kept; the others are chained.
    """
    sigs = _signatures(fps).repartition("sig")
    shared = sigs.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    multi = written(sigs.join(shared, "sig"), "signatures")
    few = multi.where(F.col("n") <= max_paired)
    pairs = (
        few.alias("x")
        .join(few.alias("y"), F.expr("x.sig = y.sig AND x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= 2"))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    many = multi.where(F.col("n") > max_paired).select("fp").distinct()
    around = many.select(
        "fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))")).alias("near")
    )
    chained = (
        around.groupBy("near")
        .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b"))
        .where("a < b")
    )
    return pairs.unionByName(chained).distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of ``prints`` (doc_id, fp).

    component_id is the smallest doc_id that is reachable by links; null where
    all documents of a group have a null doc_id.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(link_edges(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs`` (doc_id, text).

    Fingerprints link at two or fewer differing bits; a group is everything
    reachable.  Null and blank texts have fingerprint zero and are linked like
    any other.  Repeated rows give a row each; rows with a null doc_id are
    grouped but never name a group, which is null if it has no other.  An
    empty table gives no rows; other columns are ignored.

    Exact copies meet in a partial aggregation on the fingerprint, so a group
    of copies is one row from there on.
    """
    prints = written(fingerprints(docs, words), "prints")
    return (
        prints.join(components(prints), "fp")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def representatives(docs: DataFrame, words: int) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each near-duplicate group does.

    The row with the smallest doc_id stays, one without a doc_id only where no
    row of its group has one; of rows that repeat that doc_id the first does.
    All columns are kept.
    """
    rows = _rows.placed(docs, "__place")
    # a place is unique, so it names a row where doc_id does not
    places = rows.select(F.col("__place").alias("doc_id"), "text")
    ids = rows.select("__place", F.col("doc_id").cast("long").alias("doc_id"))
    grouped = near_duplicates(places, words).select(F.col("doc_id").alias("__place"), "component_id").join(ids, "__place")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__place")
    stay = grouped.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.__place").alias("__place"))
    return rows.join(stay, "__place", "left_semi").select(docs.columns)
