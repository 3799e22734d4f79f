"""Phrase collocations per language, mined over sorted occurrence relations (SETM).

The relation of phrases of k words is stored by chunks of half a million places: a
row holds the phrases that start at successive places, sorted by piece and
place, with ``GAP`` where a piece ends or no frequent phrase starts.  Joining
it with itself on the same piece and the next place, a merge of two sorted
inputs, gives the occurrences of k + 1 words, since two phrases that start
side by side share all words between them.  Groups are counted per chunk, then
by a shuffle; occurrences of frequent groups alone (a semi-join) are stored as
the next relation.

The semi-join asks a sieve, a Bloom filter of bounded size over the frequent
groups, which may let others pass: these only cost room, since every group is
counted exactly.  Words are numbered by a 64-bit hash of language and word; if
a frequent word shares its number with another word, the run starts again
with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import LARGE_ROWS, arrow_batches, written

MIN_COUNT = 30
MAX_WORDS = 4
#: A phrase goes if a longer one has this share of its occurrences, in per cent.
ABSORBED = 80
TOP = 2000
SCALE = 2_000_000
#: Places of a chunk, about (half a million bound a task to some 100 MB): a chunk ends with the document that reaches them.
CHUNK = 1 << 19
#: Chunks' worth of places that a task holds, over all languages.
OPEN_CHUNKS = 4
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Bytes of an Arrow batch that a worker is handed (a row is a text or a chunk of some megabytes), and counts that it sends at a time.
BATCH_BYTES, SENT = 4 << 20, 1 << 16
#: Bits of a sieve for each group, and at most (2 to the power); beyond that it lets more groups pass.
SIEVE_BITS, MAX_SIEVE = 16, 27
GAP = -1

_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


class _Numbers(dict):
    """Numbers words as they come; the first two are the empty string and the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` cut at spaces, so that no list of words grows with a text."""
    at = 0
    while len(data) - at > SLICE:
        cut = data.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


class _Chunk:
    def __init__(self) -> None:
        self.numbers, self.runs, self.places = _Numbers(), [], 0

    def add(self, text: bytes) -> None:
        data = text.lower().translate(_PIECES)
        for part in _slices(data):
            # the end of a piece becomes a word of its own
            words = part.replace(b"\n", b" \n ").split(b" ")
            codes = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            codes = codes[codes != 0]
            self.runs.append(codes - 2)
            self.places += len(codes)
        self.runs.append(np.array([GAP], np.int32))

    def row(self, chunk: int, lang: str, seed: int, bits: int) -> tuple:
        codes = squeezed(np.concatenate(self.runs))
        words = list(self.numbers)[2:]
        counts = np.bincount(codes[codes >= 0], minlength=len(words))
        named = lang.encode("utf-8", "surrogatepass") + b"\0"
        ids = (np.array([xxhash.xxh64_intdigest(named + w, seed) for w in words], np.uint64) >> np.uint64(64 - bits)).view(np.int64)
        return chunk, lang, [w.decode("utf-8", "surrogatepass") for w in words], ids, counts, codes


def squeezed(codes: np.ndarray) -> np.ndarray:
    """One gap for each run of gaps: only neighbours matter."""
    gap = codes < 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    return codes[keep]


_WORDS = "chunk long, lang string, words array<string>, ids array<long>, counts array<long>, codes array<int>"


def occurrences(docs: DataFrame, chunk: int = CHUNK, seed: int = 0, bits: int = 64) -> DataFrame:
    """Word occurrences of ``docs`` (lang, text) by chunks: distinct words, their ids and counts, and the sorted places."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        open_chunks: dict[str, _Chunk] = {}

        def made(lang: str) -> pa.RecordBatch:
            nonlocal first
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            columns = [pa.array([v], k) for v, k in zip(open_chunks.pop(lang).row(first, lang, seed, bits), kinds)]
            first += 1
            return pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "words", "ids", "counts", "codes"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang not in open_chunks:
                    open_chunks[lang] = _Chunk()
                open_chunks[lang].add(text.as_py())
                full = [lang] if open_chunks[lang].places >= chunk else []
                if sum(c.places for c in open_chunks.values()) >= OPEN_CHUNKS * chunk:
                    full = list(open_chunks)
                for x in full:
                    yield made(x)
        for x in list(open_chunks):
            yield made(x)

    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(each, _WORDS)


def mixed(groups: np.ndarray) -> np.ndarray:
    """A hash for each row of word ids."""
    h = np.full(len(groups), 0x9E3779B97F4A7C15, np.uint64)
    for column in groups.view(np.uint64).T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def _bits(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, mask): each hash sets four bits of one 64-bit cell; ``cells`` is a power of two."""
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(24)) & np.uint64(cells - 1)).astype(np.int64), mask


class Sieve:
    """A Bloom filter over groups of word ids, at most 2 ** ``MAX_SIEVE`` bits however many groups there are."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells

    def passes(self, groups: np.ndarray) -> np.ndarray:
        """True for every group that was put in, and for few others."""
        cell, mask = _bits(mixed(groups), len(self.cells))
        return self.cells[cell] & mask == mask


def sieve(found: DataFrame, k: int) -> Sieve:
    """The sieve of ``found`` (w1 .. wk); bits are combined by Spark, cells alone come to the driver."""
    size = 1 << min(max(found.count() * SIEVE_BITS, 64) - 1, (1 << MAX_SIEVE) - 1).bit_length()
    cells = size // 64
    names = [f"w{i}" for i in range(1, k + 1)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            cell, mask = _bits(mixed(groups), cells)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mask.view(np.int64))], ["cell", "mask"])

    rows = found.select(names).mapInArrow(each, "cell long, mask long")
    got = rows.groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(cells, np.uint64)
    table[got["cell"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Sieve(table)


_RELATION = "ids array<long>, codes array<int>"


def _arrays(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups as rows of k word ids, codes) of every chunk."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, codes = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "codes"))
            yield ids.reshape(-1, k), codes


def _stored(groups: np.ndarray, codes: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    """A chunk narrowed to the groups to ``keep``."""
    number = np.full(len(groups) + 1, GAP, np.int32)
    number[:-1][keep] = np.arange(keep.sum())
    # a gap is -1 and reads the last entry
    codes = squeezed(number[codes])
    columns = [pa.array([groups[keep].ravel()], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["ids", "codes"])


def adjacent(groups: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours joined: (longer groups, their counts, the code of the one at each place but the last, or a gap)."""
    left, right = codes[:-1], codes[1:]
    met = (left >= 0) & (right >= 0)
    key, back, n = np.unique(left[met].astype(np.int64) * len(groups) + right[met], return_inverse=True, return_counts=True)
    places = np.full(len(left), GAP, np.int32)
    places[met] = back
    size = max(len(groups), 1)
    return np.concatenate([groups[key // size], groups[key % size][:, -1:]], axis=1), n, places


def narrowed(words: DataFrame, shared: Broadcast[Sieve]) -> DataFrame:
    """The relation of the words that pass."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, codes in _arrays(batches, 1):
            yield _stored(groups, codes, shared.value.passes(groups))

    return words.select("ids", "codes").mapInArrow(each, _RELATION)


def joined(relation: DataFrame, k: int) -> DataFrame:
    """(w1 .. wk+1, n): groups of one word more, counted by chunk."""
    names = [f"w{i}" for i in range(1, k + 2)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, codes in _arrays(batches, k):
            longer, n, _ = adjacent(groups, codes)
            for at in range(0, len(n), SENT):
                columns = [*longer[at : at + SENT].T, n[at : at + SENT].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "n"])

    return relation.mapInArrow(each, ", ".join(f"{c} long" for c in (*names, "n")))


def extended(relation: DataFrame, k: int, shared: Broadcast[Sieve]) -> DataFrame:
    """The relation of k + 1 words: neighbours joined, narrowed to those that pass."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, codes in _arrays(batches, k):
            longer, _, places = adjacent(groups, codes)
            yield _stored(longer, places, shared.value.passes(longer))

    return relation.mapInArrow(each, _RELATION)


def _counted_words(docs: DataFrame, min_count: int, chunk: int, seeds: range, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(occurrences, frequent words as lang, phrase, w1, f), with ids under which no frequent word meets another word."""
    for seed in seeds:
        stored = written(occurrences(docs, chunk, seed, bits), "occurrences", LARGE_ROWS)
        each = stored.select("lang", F.explode(F.arrays_zip("words", "ids", "counts")).alias("w"))
        counted = written(
            each.groupBy("lang", F.col("w.words").alias("phrase"), F.col("w.ids").alias("w1")).agg(F.sum("w.counts").alias("f")), "words"
        )
        shared = counted.groupBy("w1").agg(F.count("*").alias("n"), F.max("f").alias("most"))
        if shared.where((F.col("n") > 1) & (F.col("most") >= min_count)).isEmpty():
            return stored, counted.where(F.col("f") >= min_count)
    raise RuntimeError("no seed keeps the words apart")


def phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, chunk: int = CHUNK, seeds: range = range(8)
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and the frequent phrases of 1, 2 .. ``max_words`` words.

    Phrases: words (array of ids), lang, phrase, last (its last word), f, head
    and tail (f of its beginnings and endings by length, itself included).
    """
    stored, frequent = _counted_words(docs, min_count, chunk, seeds)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    sizes = stored.groupBy("lang").agg(F.sum(total).alias("n"))
    own = F.array("f")
    frequent = written(frequent, "groups")
    level = frequent.select(F.array("w1").alias("words"), "lang", "phrase", F.col("phrase").alias("last"), "f", own.alias("head"), own.alias("tail"))
    levels, relation = [level], None
    for k in range(1, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(sieve(frequent, k))
        relation = written(narrowed(stored, shared) if k == 1 else extended(relation, k - 1, shared), "relation", LARGE_ROWS)
        shared.destroy()
        names = [f"w{i}" for i in range(1, k + 2)]
        counted = joined(relation, k).groupBy(*names).agg(F.sum("n").alias("f"))
        frequent = written(counted.where(F.col("f") >= min_count), "groups")
        g = frequent.select("f", F.array(*names).alias("words"), F.array(*names[:-1]).alias("prefix"), F.array(*names[1:]).alias("suffix"))
        p = level.select(F.col("words").alias("prefix"), "lang", "phrase", "head")
        s = level.select(F.col("words").alias("suffix"), "last", "tail")
        longer = g.join(p, "prefix").join(s, "suffix").select(
            "words",
            "lang",
            F.concat_ws(" ", "phrase", "last").alias("phrase"),
            "last",
            "f",
            F.concat("head", F.array("f")).alias("head"),
            F.concat("tail", F.array("f")).alias("tail"),
        )
        level = written(longer, "phrases")
        levels.append(level)
    return sizes, levels


def _not_absorbed(level: DataFrame, longer: DataFrame | None, absorbed: int) -> DataFrame:
    """Without the phrases that a phrase of one word more nearly always surrounds.

    A phrase of two words more is inside one of one word more that is at least
    as frequent, so looking one word further is enough.
    """
    if longer is None:
        return level
    inner = lambda start: F.slice("words", start, F.size("words") - 1).alias("words")
    around = longer.select(inner(1), F.col("f").alias("most")).unionByName(longer.select(inner(2), F.col("f").alias("most")))
    most = around.groupBy("words").agg(F.max("most").alias("most"))
    exact = "decimal(38,0)"
    inside = F.lit(100).cast("decimal(3,0)") * F.col("most").cast(exact) >= F.lit(absorbed).cast("decimal(3,0)") * F.col("f").cast(exact)
    return level.join(most, "words", "left").where(F.col("most").isNull() | ~inside)


def mine(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    absorbed: int = ABSORBED,
    top: int = TOP,
    chunk: int = CHUNK,
    seeds: range = range(8),
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    A-Z are lower-cased, texts end pieces at ``.,;:!?`` and line ends, words are
    runs without space and tab.  Cutting a phrase after its first words gives
    ``l`` and ``r``, the counts of both parts, and floor(2000000 a / (l + r)) in
    exact arithmetic; the lowest cut is the score, ties go to the earliest.
    ``n`` is the language's number of words.

    A null lang is ``und``, a null text has no words, repeated rows count each
    time, an empty table gives no rows, other columns are ignored.  Texts are
    read whole, in slices of bounded size.  Phrases with equal score and count
    are ordered by their bytes.  ``top`` is the length of the report.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        sizes, levels = phrases(docs, min_count, max_words, chunk, seeds)
    candidates = None
    for k in range(2, max_words + 1):
        longer = levels[k] if k < max_words else None
        kept = _not_absorbed(levels[k - 1], longer, absorbed).select("lang", "phrase", "f", "head", "tail")
        candidates = kept if candidates is None else candidates.unionByName(kept)
    cuts = F.expr(
        f"""array_min(transform(sequence(1, size(head) - 1), k -> named_struct(
              'score', (cast({SCALE} AS decimal(7,0)) * cast(f AS decimal(20,0)))
                       div (cast(head[k - 1] AS decimal(20,0)) + cast(tail[size(head) - k - 1] AS decimal(20,0))),
              'k', k, 'l', head[k - 1], 'r', tail[size(head) - k - 1])))"""
    )
    scored = candidates.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
