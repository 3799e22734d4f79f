"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents and attention cost (the
square tiles that block-diagonal attention computes, which rounds every piece
up to whole tiles).  Every piece goes, longest first, to the open sequence
that has room in all three and leaves the smallest weighted residual norm (or
gives the largest weighted dot product of demand and residual).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tokens import encoder
from tessera.session import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE_TOKENS = 2048
END_ID = 0
#: Documents a sequence may hold: binds where only short pieces are left, before it costs sequences.
SEQUENCE_DOCS = 64
#: Side of an attention tile in tokens.
TILE = 128
#: Attention tiles of a sequence: those of one full piece, and one more so that a short piece can join a nearly full one.
SEQUENCE_COST = (SEQUENCE_TOKENS // TILE) ** 2 + 1
#: Weights of tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 0.05, 0.05)
#: Pieces one packing task holds; the number of tasks grows with the corpus.
SHARD_PIECES = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tiles(length):
    """Attention tiles of a piece, a number or an array of them."""
    return (-(-length // TILE)) ** 2


def best_fit(
    lengths: np.ndarray,
    tokens: int = SEQUENCE_TOKENS,
    docs: int = SEQUENCE_DOCS,
    cost: int = SEQUENCE_COST,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; every length is from 1 to ``tokens``, and a piece alone fits the other capacities.

    Longest pieces first, equal ones in the order given; of equally good
    sequences the one opened first.  Open sequences with the same residuals
    are alike, so they are kept once per residual vector with a stack of
    their numbers, and a piece is scored against the distinct vectors alone.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    full = np.array([tokens, docs, cost], np.float64)
    scale = np.array(weights) / full**2
    state = np.empty((1024, 3))
    members: list[list[int]] = []
    place: dict[tuple[int, int, int], int] = {}
    fill: list[int] = []
    used = 0
    for k in order.tolist():
        n = int(lengths[k])
        demand = np.array([n, 1, tiles(n)], np.float64)
        chosen = -1
        if used:
            left = state[:used] - demand
            fits = (left >= 0).all(1)
            if fits.any():
                if score == "dot":
                    value = -(state[:used] * demand) @ scale
                else:
                    value = (left * left) @ scale
                chosen = int(np.argmin(np.where(fits, value, np.inf)))
        if chosen < 0:
            number, was = len(fill), full
            fill.append(0)
        else:
            number, was = members[chosen].pop(0), state[chosen].copy()
            if not members[chosen]:  # the last vector takes the free place
                used -= 1
                del place[tuple(map(int, was))]
                if chosen != used:
                    place[tuple(map(int, state[used]))] = chosen
                    state[chosen], members[chosen] = state[used], members[used]
                members.pop()
        sequence[k], offset[k] = number, fill[number]
        fill[number] += n
        now = was - demand
        if now[0] > 0 and now[1] > 0 and now[2] > 0:
            key = tuple(map(int, now))
            if key in place:
                members[place[key]].append(number)
            else:
                if used == len(state):
                    state = np.concatenate([state, np.empty_like(state)])
                place[key] = used
                state[used] = now
                members.append([number])
                used += 1
    return sequence, offset


def _cut_pieces(path: str, size: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = batch.column("text")
            for first, last, ids, n in tokens.batches(texts):
                rows, at = [], 0
                for k in range(first, last):
                    own = np.concatenate([ids[at : at + n[k - first]], end]).astype("<u4")
                    at += int(n[k - first])
                    for piece, start in enumerate(range(0, len(own), size)):
                        part = own[start : start + size]
                        rows.append((k, piece, start, len(part), zlib.crc32(part.tobytes())))
                doc, piece, start, length, crc = map(np.array, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc.astype(np.int64)),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def cut_pieces(
    docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SEQUENCE_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and ``end_id``, cut only where longer than ``size``.

    A null text counts as empty and has the end id alone.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_cut_pieces(tokenizer, size, end_id), _PIECES)


def pack(
    pieces: DataFrame,
    tokens: int = SEQUENCE_TOKENS,
    docs: int = SEQUENCE_DOCS,
    cost: int = SEQUENCE_COST,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece (a row with ``length`` from 1 to ``tokens``).

    Pieces are dealt into shards of about ``shard_pieces`` by a hash of the
    piece's contents, place and row, so all shards see the same mix of lengths
    (rows that repeat are spread too) and each leaves at most a few sequences
    part-filled.  ``pieces`` is a stored table, so a task that is run again
    deals the same rows.  Offsets in a sequence
    are gapless from 0 and every capacity holds.  Sequence ids are unique,
    their order has no meaning.  Columns of the input called sequence_id or
    offset are replaced.  No pieces give no rows.
    """
    if cost < tiles(tokens) or docs < 1:
        raise ValueError("a full piece must fit a sequence of its own")
    n = pieces.count()
    shards = max(1, -(-n // shard_pieces))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "__shard")]
    dealt = pieces.select(
        *kept, F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).alias("__shard")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*kept).schema)

    def packed(shard: pa.Table) -> pa.Table:
        order = [("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        shard = shard.sort_by(order)
        sequence, offset = best_fit(shard["length"].to_numpy(), tokens, docs, cost, weights, score)
        base = shard["__shard"][0].as_py() << 32
        return shard.select(kept).append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("__shard").applyInArrow(packed, f"{schema}, sequence_id long, offset long")


def residuals(
    packed: DataFrame, tokens: int = SEQUENCE_TOKENS, docs: int = SEQUENCE_DOCS, cost: int = SEQUENCE_COST
) -> DataFrame:
    """sequence_id, tokens_left, docs_left, cost_left: the room left in every sequence of ``pack``."""
    tile = F.ceil(F.col("length") / TILE)
    return packed.groupBy("sequence_id").agg(
        (F.lit(tokens) - F.sum("length")).alias("tokens_left"),
        (F.lit(docs) - F.count("*")).alias("docs_left"),
        (F.lit(cost) - F.sum(tile * tile)).alias("cost_left"),
    )


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text); one row per piece.

    Repeated rows and repeated or null doc_ids are packed row by row.
    """
    return pack(written(cut_pieces(docs, tokenizer), "pieces"))
