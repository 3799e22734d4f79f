"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

Documents and benchmark items become sequences of word hashes.  The CGK
embedding walks over a sequence: step j emits the current word and moves on
if bit j of the word's (walk-specific) hash is set, so two sequences that
differ by an edit fall back into step by chance, and edit distance turns into
Hamming distance between the emitted words.  Windows are as long as the items:
an item belongs to the largest class of ``sizes`` that it fills, and windows of
that size start at every ``stride_of``-th word of a document and at as many
first words of the item.  Each of several tables samples a few coordinates of
the embedding; windows equal on them are candidates.  The walks alone find nine
of ten items at the most edits allowed; besides, each item is cut into one piece more than it may have edits:
one piece at least is unedited in every stretch that counts, and is looked up
at every word of a document, so that no pair is missed at any length.  A
candidate is verified by exact edit distance between the item and the aligned
stretch of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _files, _held
from tessera.llm._tokens import spread
from tessera.session import scratch, written

SIMILARITY = 0.8
#: Ratio of one class of window sizes to the next.
SIZE_RATIO = 1.25
#: Window start distance in documents for windows of LONG_WINDOW words and more; items are indexed from as many starts.
STRIDE = 4
LONG_WINDOW = 16
#: Windows from so many words on start at every second word.
MIDDLE_WINDOW = 12
#: First words of an item that a window of ``SHORT_WINDOW`` words and more starts at.
STARTS, SHORT_WINDOW = 4, 4
#: (steps of the walk a table may sample as a share of two per word, coordinates sampled), one row a table and walk.
TABLES = ((0.2, 3),)
WALKS = 10
SEED = 7
#: Items in one block of the benchmark; a task holds one block's index at a time.
BLOCK_ITEMS = 20_000
#: Words of benchmark text in one block at most.
BLOCK_WORDS = 2_000_000
WORD = "[^\\p{L}\\p{N}]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A well mixed 64-bit hash for one walk."""
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * _M1
    return (h ^ (h >> np.uint64(29))) * _M2


def stride_of(size: int) -> int:
    """Distance of window starts in documents; windows of few words start at every word."""
    return STRIDE if size >= LONG_WINDOW else 2 if size >= MIDDLE_WINDOW else 1


def starts_of(size: int) -> int:
    """First words of an item that windows of ``size`` start at, at least as many as ``stride_of``."""
    return STARTS if size >= SHORT_WINDOW else 1


def class_of(n: int) -> int:
    """Window size of an item of ``n`` words: the largest of 1, 2, 3, ... times ``SIZE_RATIO`` that leaves room for the starts."""
    best, size = 1, 1
    while size + starts_of(size) - 1 <= n:
        best, size = size, max(size + 1, int(size * SIZE_RATIO))
    return best


def plan(size: int) -> list[list[tuple[int, list[int]]]]:
    """For every walk: (table number, coordinates) pairs for windows of ``size`` words.

    A walk is in step with that of an edited copy mostly at its beginning, so
    only the first share of its steps is sampled.  Coordinates are drawn one
    from each of as many equal stretches: neighbours mostly are one word.
    """
    rng = np.random.default_rng(SEED)
    walks, number = [], 0
    for _ in range(WALKS):
        tables = []
        for share, k in TABLES:
            steps = max(1, round(2 * size * share))
            cuts = np.linspace(0, steps, min(k, steps) + 1).astype(int).tolist()
            tables.append((number, [int(rng.integers(a, b)) for a, b in zip(cuts, cuts[1:])]))
            number += 1
        walks.append(tables)
    return walks


def sketch(words: np.ndarray, starts: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, table number, keys) of the windows at ``starts``; ``words`` is padded by twice the largest size.

    A walk does not know its window's size, so one serves all sizes.
    """
    for w in range(WALKS):
        moves = mix(words, w + 1)
        at = starts.copy()
        wanted: dict[int, list[tuple[int, int]]] = {}
        keys = {}
        for size in sizes:
            for t, chosen in plan(size)[w]:
                keys[size, t] = np.full(len(starts), t + 1 + 64 * size, np.uint64)
                for j in chosen:
                    wanted.setdefault(j, []).append((size, t))
        for j in range(max(wanted) + 1):
            if j in wanted:
                emitted = words[at]
                for name in wanted[j]:
                    key = (keys[name] ^ emitted) * _M1
                    keys[name] = key ^ (key >> np.uint64(31))
            at += ((moves[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        for (size, t), key in keys.items():
            yield size, t, key


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A key of the ``size`` words at every position that has as many."""
    keys = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for j in range(size):
        keys = (keys ^ words[j : j + len(keys)]) * _M1
        keys ^= keys >> np.uint64(31)
    return keys


def edits_of(words: int, similarity: float) -> int:
    """Edits that an item of so many words may have."""
    return int((1 - similarity) * words + 1e-9)


def _table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(key, item, start) in the order of keys, and the leading key bits that occur."""
    key, item, start = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, item, start = key[order], item[order], start[order]
    bits = np.zeros(1 << 20, bool)
    bits[(key >> np.uint64(44)).astype(np.int64)] = True
    return key, item, start, bits


def fit(item: np.ndarray, words: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edits, end) of the stretch of ``words`` nearest to the whole item, if at most ``most`` edits away.

    Bit-parallel edit distance with a free start and end in ``words``; exact.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for k, w in enumerate(words.tolist()):
        eq = masks.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        plus = down | (full & ~(d | up))
        minus = up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(d | plus))
        down = plus & d
        if score < best:
            best, end = score, k + 1
    return (best, end) if best <= most else None


@dataclass
class Index:
    """The LSH tables and, but where ``pieces_too`` is false, the pieces of a block of items."""

    items: list[tuple[object, np.ndarray]]
    similarity: float
    pieces_too: bool = True

    def __post_init__(self) -> None:
        self.distinct = [set(w.tolist()) for _, w in self.items]
        self.length = np.array([len(w) for _, w in self.items], np.int64)
        self.most = np.array([edits_of(n, self.similarity) for n in self.length.tolist()], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *(w for _, w in self.items)])
        self.first = np.cumsum(self.length) - self.length
        keys: dict[tuple[int, int], list] = {}
        for k, (_, w) in enumerate(self.items):
            size = class_of(len(w))
            padded = np.concatenate([w, np.zeros(2 * size + 8, np.uint64)])
            starts = np.arange(min(starts_of(size), len(w) - size + 1))
            for _, t, found in sketch(padded, starts, [size]):
                keys.setdefault((size, t), []).append((found, np.full(len(starts), k), starts))
        self.tables = {name: _table(parts) for name, parts in keys.items()}
        pieces: dict[int, list] = {}
        for k, (_, w) in enumerate(self.items if self.pieces_too else []):
            n = min(int(self.most[k]) + 1, len(w))
            cuts = [len(w) * i // n for i in range(n + 1)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(b - a, []).append((grams(w[a:b], b - a), np.array([k]), np.array([a])))
        self.pieces = {size: _table(parts) for size, parts in pieces.items()}

    def _lookups(self, words: np.ndarray) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
        """(table, keys, their places in ``words``) of everything that is looked up."""
        for size, table in self.pieces.items():
            keys = grams(words, size)
            yield table, keys, np.arange(len(keys))
        for stride in (1, 2, STRIDE):
            sizes = sorted({s for s, _ in self.tables if stride_of(s) == stride})
            if sizes:
                padded = np.concatenate([words, np.zeros(2 * sizes[-1] + 8, np.uint64)])
                starts = np.arange(0, len(words), stride)
                for size, t, keys in sketch(padded, starts, sizes):
                    yield self.tables[size, t], keys, starts

    def candidates(self, words: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
        """(document, item, origin) rows, sorted; matches of one alignment share a row."""
        found = [np.zeros((0, 4), np.int64)]
        for (key, item, start, bits), keys, starts in self._lookups(words):
            maybe = np.flatnonzero(bits[(keys >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(key, keys[maybe], "left")
            n = np.searchsorted(key, keys[maybe], "right") - low
            # matches of a piece that many items share are made a slice at a time
            ends = np.cumsum(n)
            first = 0
            while first < len(n):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_MATCHES, "right")))
                posting = spread(low[first:last], n[first:last])
                at = np.repeat(starts[maybe[first:last]], n[first:last])
                own = item[posting]
                origin = at - start[posting]
                rows = np.stack([doc_of[at], own, origin // (self.most[own] + 1), origin], 1)
                found.append(_distinct(rows))
                first = last
        return _distinct(np.concatenate(found))[:, [0, 1, 3]]

    def _possible(self, words: np.ndarray, item: np.ndarray, origin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """False where more of an item's words, a few evenly spaced ones, are missing near their places than it may have edits."""
        keep = np.ones(len(item), bool)
        for most in np.unique(self.most[item]).tolist():
            group = np.flatnonzero(self.most[item] == most)
            near = np.arange(-2 * most - 1, 2 * most + 2)
            for part in np.array_split(group, -(-len(group) * (most + 10) * len(near) // CHECKED)):
                n = self.length[item[part]]
                # all of a short item's words, some of a long one's
                k = np.minimum(np.arange(most + 10) * np.maximum(n, most + 10)[:, None] // (most + 10), n[:, None])
                real = k < n[:, None]
                wanted = self.flat[self.first[item[part]][:, None] + np.where(real, k, 0)]
                at = (origin[part][:, None] + k)[:, :, None] + near
                inside = (at >= low[part][:, None, None]) & (at < high[part][:, None, None])
                seen = ((words[np.clip(at, 0, len(words) - 1)] == wanted[:, :, None]) & inside).any(2)
                keep[part] = (real & ~seen).sum(1) <= most
        return keep

    def search(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, edits, word offset of the stretch's end) for every contaminated pair.

        ``words`` holds the documents one after the other, ``bounds`` their
        ends; every pair is reported once, with its fewest edits.
        """
        doc_of = np.repeat(np.arange(len(bounds)), np.diff(bounds, prepend=0))
        begin = np.concatenate([[0], bounds[:-1]]).astype(np.int64)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        rows = self.candidates(words, doc_of)
        most, length = self.most[rows[:, 1]], self.length[rows[:, 1]]
        low = np.maximum(begin[rows[:, 0]], rows[:, 2] - 2 * most - 1)
        high = np.minimum(bounds[rows[:, 0]], rows[:, 2] + length + 2 * most + 1)
        keep = self._possible(words, rows[:, 1], rows[:, 2], low, high)
        rows, most, low, high = rows[keep], most[keep], low[keep], high[keep]
        for doc, k, a, b, least in zip(rows[:, 0].tolist(), rows[:, 1].tolist(), low.tolist(), high.tolist(), most.tolist()):
            if best.get((doc, k), (1, 0))[0] == 0:
                continue
            # every distinct word that the stretch lacks costs an edit
            if len(self.distinct[k].difference(words[a:b].tolist())) > least:
                continue
            found = fit(self.items[k][1], words[a:b], least)
            if found and found < best.get((doc, k), (1 << 30, 0)):
                best[doc, k] = found[0], a + found[1] - int(begin[doc])
        for (doc, k), (edits, end) in sorted(best.items()):
            yield doc, k, edits, end


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted rows without those that repeat the first three columns."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[new]


def words_of(text: str = "text"):
    """Array of 64-bit hashes of the lower-cased words (runs of letters and digits) of a whole text."""
    split = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD)
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


_HITS = "doc_id long, item_id long, edits int, item_words int, end_word long"
SLICE_WORDS = 1_000_000
SLICE_MATCHES = 2_000_000
#: Words compared at a time where candidates are sifted.
CHECKED = 2_000_000
#: Words of documents held while the blocks of a benchmark of several blocks pass by.
HELD_WORDS = 16_000_000
_last: dict[tuple, Index] = {}


@dataclass
class Blocks:
    """Items as word hashes in the shared folder, in blocks of bounded size."""

    folder: str
    count: int
    similarity: float

    def index(self, k: int) -> Index:
        """The index of a block; a worker keeps the last one."""
        _held.take("decontam", _last.clear)
        name = (self.folder, k, self.similarity)
        if name not in _last:
            _last.clear()
            system, path = _files.opened(f"{self.folder}/block={k}")
            items = []
            for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    with system.open_input_file(info.path) as file:
                        rows = pq.ParquetFile(file).read()
                    items += [
                        (i, np.array(w, np.int64).view(np.uint64))
                        for i, w in zip(rows["item_id"].to_pylist(), rows["words"].to_pylist())
                    ]
            _last[name] = Index(items, self.similarity)
        return _last[name]


def store_items(items: DataFrame, similarity: float = SIMILARITY) -> Blocks:
    """Write the items that have words (item_id, text) as blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words at most.

    Only two sums come to the driver, however many items there are.
    """
    rows = written(items.select(F.col("item_id").cast("long"), words_of().alias("words")).where(F.size("words") > 0), "items")
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    count = max(-(-n // BLOCK_ITEMS), -(-words // BLOCK_WORDS))
    folder = scratch(items.sparkSession, "item-blocks")
    block = F.pmod(F.xxhash64("item_id", "words", F.monotonically_increasing_id()), F.lit(max(1, count))).cast("int")
    rows.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(folder)
    return Blocks(folder, count, similarity)


def contaminations(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, edits, item_words, end_word, similarity: one row per document row and benchmark item it holds.

    A document holds an item if some stretch of its words is within
    ``(1 - similarity) * n`` word edits of the item's n words, case and
    punctuation aside.  ``edits`` is the verified distance of the stretch that
    ends before word ``end_word``.  Documents or items without words, null
    texts among them, match nothing; null ids are kept; rows that repeat give
    a row each.  Other columns are ignored.

    Documents are scanned once, where they lie, without a shuffle.  A
    benchmark of several blocks passes by a bounded run of documents block by
    block, so a task holds one block's index at a time.
    """
    blocks = store_items(items, similarity)
    rows = docs.select(F.col("doc_id").cast("long"), words_of().alias("words"))
    return rows.mapInArrow(_scan(blocks), _HITS).withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches gathered to about ``most`` words, so that a block is opened once for many documents."""
    held, words = [], 0
    for batch in batches:
        held.append(batch)
        words += len(batch.column("words").flatten())
        if words >= most:
            yield pa.Table.from_batches(held)
            held, words = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _hits(index: Index, lists: pa.ListArray) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(number of the first document, hits) of slices of bounded size."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_WORDS, "right")) - 1)
        yield first, list(index.search(flat[ends[first] : ends[last]], ends[first + 1 : last + 1] - ends[first]))
        first = last


def _scan(blocks: Blocks):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1 if blocks.count <= 1 else HELD_WORDS):
            for k in range(blocks.count):
                index = blocks.index(k)
                for batch in run.to_batches():
                    for first, hits in _hits(index, batch.column("words")):
                        if hits:
                            doc, item, edits, end = map(np.array, zip(*hits))
                            yield pa.RecordBatch.from_arrays(
                                [
                                    batch.column("doc_id").take(pa.array(doc + first)),
                                    pa.array([index.items[j][0] for j in item], pa.int64()),
                                    pa.array(edits.astype(np.int32)),
                                    pa.array(index.length[item].astype(np.int32)),
                                    pa.array(end.astype(np.int64)),
                                ],
                                ["doc_id", "item_id", "edits", "item_words", "end_word"],
                            )

    return scan


def clean_documents(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns.

    Every row is judged by itself, where it lies: ids may be null or repeat.
    """
    blocks = store_items(items, similarity)

    @F.arrow_udf("boolean")
    def holds(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrow = (pa.RecordBatch.from_arrays([b], ["words"]) for b in lists)
        # a block is opened once for a run of documents
        for run in _runs(arrow, 1 if blocks.count <= 1 else HELD_WORDS):
            held = run.to_batches()
            found = [np.zeros(b.num_rows, bool) for b in held]
            for k in range(blocks.count):
                index = blocks.index(k)
                for batch, holding in zip(held, found):
                    for first, hits in _hits(index, batch.column("words")):
                        holding[[first + doc for doc, *_ in hits]] = True
            yield from map(pa.array, found)

    return docs.where(~holds(words_of()))
