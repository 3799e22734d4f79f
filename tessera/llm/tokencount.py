"""Exact token counts of whole texts; huge texts are encoded in overlapping chunks.

A chunk is encoded with offsets together with ``overlap`` characters on
either side.  Two neighbours meet at a *stable* boundary that both saw: a
token start at a lone space between two characters that are no white space.
A byte-level pre-tokenizer starts a token at every such place whatever
surrounds it, so tokens before it from the left chunk and after it from the
right chunk are the tokens of the whole text.  Where two neighbours share no
stable boundary the text is done again with wider overlaps, at last whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._tokens import encoder
from tessera.session import written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Texts longer than this are encoded in chunks.
CHUNK_CHARS = 6_000
OVERLAP_CHARS = 300
WIDEN = 16
LIMIT = 512

_LONE = re.compile(r"(?<=\S) (?=\S)")
_SUMMARY = "row long, k int, total long, last boolean, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def _count_small(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            n = [np.zeros(0, np.int64), *(part for *_, part in tokens.batches(batch.column("text"), want_ids=False))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(np.concatenate(n)), pa.array(np.ones(len(batch), np.int64))],
                ["doc_id", "n_bytes", "n_tokens", "n_chunks"],
            )

    return count


#: Chunks handed on at a time.
BATCH_CHUNKS = 1_000


def _cut(chunk: int, overlap: int):
    names = ["row", "k", "begin", "core", "last", "part"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in batches:
            for row, text in zip(pdf["row"], pdf["text"]):
                n = len(text)
                for k, at in enumerate(range(0, n, chunk)):
                    begin, end = max(0, at - overlap), min(n, at + chunk + overlap)
                    held.append((row, k, begin, at, at + chunk >= n, text[begin:end]))
                    if len(held) == BATCH_CHUNKS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return cut


def stable_starts(part: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, tokens before each) of those token ``starts`` that hold in any surroundings."""
    lone = np.array([m.start() for m in _LONE.finditer(part)], np.int64)
    n = np.searchsorted(starts, lone)
    held = n < len(starts)
    held[held] = starts[n[held]] == lone[held]
    return lone[held], n[held]


def _summarise(path: str, chunk: int, overlap: int):
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = encoder(path).library
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                offsets = library.encode(r.part, add_special_tokens=False).offsets
                at, n = stable_starts(r.part, np.fromiter((a for a, _ in offsets), np.int64, len(offsets)))
                at = at + r.begin
                left = (at >= r.core - overlap) & (at < r.core + overlap) & (r.k > 0)
                right = (at >= r.core + chunk - overlap) & (at < r.core + chunk + overlap) & (not r.last)
                rows.append((r.row, r.k, len(offsets), r.last, at[left], n[left], at[right], n[right]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SUMMARY.split(", ")])

    return summarise


def _splice(summaries: DataFrame) -> DataFrame:
    """(row, n_tokens, n_chunks); n_tokens is null where two neighbours found no common stable boundary."""
    order = Window.partitionBy("row").orderBy("k")
    common = F.array_intersect("right_at", F.lead("left_at").over(order))
    s = summaries.withColumn("meet", F.get(common, F.floor(F.size(common) / 2).cast("int")))
    s = s.withColumn("met", F.lag("meet").over(order))
    before = lambda at, n, place: F.get(F.col(n), (F.array_position(at, place) - 1).cast("int"))
    own = F.when(F.col("last"), F.col("total")).otherwise(before("right_at", "right_n", F.col("meet"))) - F.when(
        F.col("k") == 0, F.lit(0)
    ).otherwise(before("left_at", "left_n", F.col("met")))
    # a sum skips nulls, so a chunk without a meeting place is counted apart
    return (
        s.withColumn("own", own)
        .groupBy("row")
        .agg(F.when(F.count("own") == F.count("*"), F.sum("own")).alias("n_tokens"), F.count("*").alias("n_chunks"))
    )


def _count_huge(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Counts of texts longer than ``chunk``; docs has doc_id, text, n_bytes and row."""
    open_rows, done = docs, []
    while True:
        chunks = open_rows.select("row", "text").mapInPandas(
            _cut(chunk, overlap), "row long, k int, begin long, core long, last boolean, part string"
        )
        # the chunks of one huge text are spread over the cluster
        dealt = chunks.repartition(F.col("row"), F.col("k"))
        counted = written(_splice(dealt.mapInPandas(_summarise(path, chunk, overlap), _SUMMARY)), "token-counts")
        done.append(counted.where("n_tokens IS NOT NULL"))
        failed = counted.where("n_tokens IS NULL").select("row")
        if not failed.head(1):
            break
        # each round is wider, and a text no longer than a chunk is one chunk, which cannot fail
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        open_rows = open_rows.join(failed, "row", "left_semi")
    counts = done[0]
    for more in done[1:]:
        counts = counts.unionByName(more)
    return docs.select("row", "doc_id", "n_bytes").join(counts, "row").select("doc_id", "n_bytes", "n_tokens", "n_chunks")


def count_tokens(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    limit: int = LIMIT,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks and over_limit (n_tokens > limit) for every row of ``docs``.

    Counts are those of ``encode(text, add_special_tokens=False)`` on the
    whole text, without truncation; special strings inside a text count as the
    library counts them.  Null and empty texts have 0 bytes and 0 tokens.
    Rows are neither merged nor dropped, doc_id may be null or repeat, other
    columns are ignored.  ``tokenizer`` is a byte-level ``.json`` vocabulary;
    others, whose tokens may cross a lone space, are refused.  ``n_chunks``
    says how many chunks a text was spliced from.

    Texts up to ``chunk_chars`` are one task-local step without a shuffle.
    Longer ones become chunk rows dealt over the cluster, so that no task
    holds the tokens of more than one chunk.
    """
    if not encoder(tokenizer).byte_level:
        raise ValueError("chunks are spliced for byte-level vocabularies only")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
    )
    small = rows.where(F.char_length("text") <= chunk_chars).mapInArrow(
        _count_small(tokenizer), "doc_id long, n_bytes long, n_tokens long, n_chunks long"
    )
    huge = rows.where(F.char_length("text") > chunk_chars)
    if huge.head(1):
        huge = written(huge.withColumn("row", F.monotonically_increasing_id()), "huge-texts")
        small = small.unionByName(_count_huge(huge, tokenizer, chunk_chars, overlap_chars))
    return small.withColumn("over_limit", F.col("n_tokens") > limit)
