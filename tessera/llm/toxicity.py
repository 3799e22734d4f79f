"""Toxicity from the nearest labelled examples.

Labelled documents become TF-IDF vectors over all of their words and word
beginnings.  A feature's weight is its idf times one plus the evidence, beyond
chance, that it comes with toxic labels; no feature and no example is left
out.  A block-max inverted index over the examples gives every document's
exact nearest neighbours by cosine, itself excepted; their distance-weighted
votes, calibrated on the examples themselves, are its score and the neighbours
the evidence.  Texts are scored in small batches: the long lists of all of
them go through one product a block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _held
from tessera.llm._tokens import spread
from tessera.session import written

#: Labelled documents the classifier is fitted on at most, chosen by a hash of doc_id.
MAX_EXAMPLES = 4_000
#: Postings of the index at most, of fewer examples where their texts are very long; what is broadcast takes about 10 bytes each.
MAX_POSTINGS = 12_000_000
#: Lengths of the word beginnings that are features beside the words; inflected words share them.
PREFIXES = (6,)
NEIGHBOURS = 15
BLOCK = 64
#: Features of more than this share of the examples have dense postings with block maxima; shorter lists are walked whole.
LONG_SHARE = 0.1
#: Features with dense postings at most, the longest lists; what a worker holds of them takes 16 KB each.
LONG_ROWS = 1_000
#: Texts scored together, and their characters at most unless one text is longer; results do not depend on them.
TEXTS = 64
TEXT_CHARS = 1_000_000
#: Rows of a batch whose texts are strings at a time.
_ROWS = 1_024
THRESHOLD = 0.3
#: Weight of the base rate beside the votes.
PRIOR_WEIGHT = 0.02
#: Examples in a calibration step.
STEP_EXAMPLES = 40
_WORD = re.compile(r"\w+")
#: Postings weighed at a time.
_AT_ONCE = 1 << 18
#: Words whose features a worker remembers.
_MEMO = 250_000
#: More than single precision can err by in a cosine: a product of LONG_ROWS terms that are not negative, by 6e-5 of itself.
_SLACK = 1e-4


def features(word: str) -> list[str]:
    """The features of a lower-case word: itself and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def hashed(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of a whole text's features."""
    counts: dict[int, int] = {}
    for word, n in words(text).items():
        for f in map(hashed, features(word)):
            counts[f] = counts.get(f, 0) + n
    at = np.array(sorted(counts), np.uint64)
    return at, np.array([counts[k] for k in at.tolist()], np.int64)


def evidence(n: np.ndarray, bad: np.ndarray, base: float) -> np.ndarray:
    """Chernoff exponent of ``bad`` toxic ones among ``n`` examples by chance; 0 unless more than the base rate."""
    rate = bad / n
    with np.errstate(divide="ignore", invalid="ignore"):
        toxic = np.where(bad > 0, bad * np.log(rate / base), 0.0)
        clean = np.where(n > bad, (n - bad) * np.log((1 - rate) / (1 - base)), 0.0)
    return np.where(rate > base, toxic + clean, 0.0)


class _Codes(dict):
    """Word -> code; new words get the next code and are noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


@dataclass
class Model:
    """Feature weights and the block-max inverted index of the examples.

    ``ids`` and ``toxic`` (0 or 1) say what the examples are, ``doc``, ``term``
    and ``tf`` hold a row for every feature of every example, an example's by
    rising term.
    """

    ids: np.ndarray
    toxic: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray] | None = None
    memo: _Codes = field(default_factory=_Codes, repr=False)

    def __post_init__(self) -> None:
        n = len(self.ids)
        # by term and in small types: all of this is held by the driver
        order = np.argsort(self.term, kind="stable")
        term = self.term[order]
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        self.keys, self.start = term[new], np.flatnonzero(new)
        del term
        doc, tf = self.doc[order].astype(np.int32, copy=False), self.tf[order]
        del order
        self.doc = self.term = self.tf = self.dense = None
        term = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del new
        df = np.diff(self.start, append=len(term))
        base = float(self.toxic.mean()) if n else 0.0
        self.weight = np.log((1 + n) / (1 + df)) if n else np.zeros(0)
        if 0 < base < 1:
            found = evidence(df, np.bincount(term[(self.toxic > 0)[doc]], minlength=len(self.keys)), base)
            # as many features were looked at, so that much evidence is chance
            self.weight = self.weight * (1 + np.maximum(0.0, found - np.log(len(self.keys))))
        w = tf.astype(np.float64)
        del tf
        slices = [slice(k, k + _AT_ONCE) for k in range(0, len(w), _AT_ONCE)]
        norm, most, heaviest = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for s in slices:
            w[s] = (1 + np.log(w[s])) * self.weight[term[s]]
            np.add.at(norm, doc[s], w[s] * w[s])
        norm = np.sqrt(norm)
        for s in slices:
            w[s] /= np.where(norm > 0, norm, 1)[doc[s]]
            np.maximum.at(most, doc[s], w[s])
        # of equally heavy features the last
        for s in slices:
            own = w[s] == most[doc[s]]
            heaviest[doc[s][own]] = term[s][own]
        # examples without any weighted feature: the share of toxic ones among them, smoothed
        blank = norm == 0
        self.empty_rate = float((self.toxic[blank].sum() + 0.1) / (blank.sum() + 1)) if n else 0.0
        # alike examples share blocks, so that block maxima tell blocks apart
        order = np.lexsort((self.ids, heaviest))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        self.ids, self.toxic = self.ids[order], self.toxic[order]
        self.at_id = {int(k): j for j, k in enumerate(self.ids.tolist())}
        self.blocks = max(1, -(-n // BLOCK))
        doc, w = place[doc], w.astype(np.float32)
        order = np.lexsort((doc, term))
        del term
        self.post_doc, self.post_w = doc[order], w[order]
        self.size = df
        long = np.flatnonzero(df > max(BLOCK, LONG_SHARE * n))
        long = np.sort(long[np.argsort(-df[long], kind="stable")[:LONG_ROWS]])
        self.row = np.full(len(self.keys), -1, np.int64)
        self.row[long] = np.arange(len(long))
        self.forget()

    def forget(self) -> None:
        """Forget the features of words."""
        self.memo = _Codes()
        self.known = np.zeros((1 << 14, 1 + len(PREFIXES)), np.int32)

    def _long(self) -> tuple[np.ndarray, np.ndarray]:
        """(dense postings, block maxima) of the long lists, made by the worker that asks first."""
        if self.dense is None:
            long = np.flatnonzero(self.row >= 0)
            self.dense = np.zeros((len(long), self.blocks * BLOCK), np.float32)
            where = spread(self.start[long], self.size[long])
            self.dense[np.repeat(np.arange(len(long)), self.size[long]), self.post_doc[where]] = self.post_w[where]
            self.most = self.dense.reshape(len(long), self.blocks, BLOCK).max(2)
        return self.dense, self.most

    def _learn(self) -> None:
        """Look up the features of the new words; -1 stands for one the index does not have."""
        end, new = len(self.memo), self.memo.new
        if end > len(self.known):
            self.known = np.concatenate([self.known, np.zeros((max(end, 2 * len(self.known)) - len(self.known), self.known.shape[1]), np.int32)])
        each = [features(w) for w in new]
        flat = np.fromiter(map(hashed, chain.from_iterable(each)), np.uint64)
        at = np.searchsorted(self.keys, flat)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == flat, at, -1) if len(self.keys) else np.full(len(flat), -1)
        n = np.fromiter(map(len, each), np.int64, len(each))
        # new codes are the last ones, in order
        rows = self.known[end - len(new) : end]
        rows[:] = -1
        rows[np.repeat(np.arange(len(new)), n), spread(np.zeros(len(n), np.int64), n)] = at
        new.clear()

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features per text, features known to the index, weights) of whole texts, each of length one."""
        if len(self.memo) > _MEMO:
            self.forget()
        code = self.memo.__getitem__
        codes = [np.fromiter(map(code, _WORD.findall((t or "").lower())), np.int64) for t in texts]
        if self.memo.new:
            self._learn()
        known = self.known[np.concatenate(codes)]
        text = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        key, tf = np.unique((text[:, None] * len(self.keys) + known)[known >= 0], return_counts=True)
        text, at = np.divmod(key, max(1, len(self.keys)))
        w = (1 + np.log(tf)) * self.weight[at]
        text, at, w = text[w > 0], at[w > 0], w[w > 0]
        return np.bincount(text, minlength=len(texts)), at, w / np.sqrt(np.bincount(text, weights=w * w, minlength=len(texts)))[text]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(features known to the index, weights) of a whole text, of length one."""
        return self.vectors([text])[1:]

    def all_nearest(
        self, count: np.ndarray, at: np.ndarray, weight: np.ndarray, skip: list[int | None], k: int = NEIGHBOURS
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each of several texts, of which ``count`` says how many features are whose.

        Short lists are added up first.  What a block can reach is then
        bounded by the block maxima of the long lists; blocks whose bound is
        below the k-th sum so far are left out, the others get the long lists
        in one product a block.  That is in single precision, so whatever may
        be among the k is added up again in double.
        """
        dense, most = self._long()
        row, ends = self.row[at], np.cumsum(count)
        query = np.zeros((len(count), len(dense)), np.float32)
        long = np.flatnonzero(row >= 0)
        query[np.repeat(np.arange(len(count)), count)[long], row[long]] = weight[long]
        part = np.zeros((len(count), self.blocks * BLOCK))
        for i, (first, end) in enumerate(zip((ends - count).tolist(), ends.tolist())):
            short = first + np.flatnonzero(row[first:end] < 0)
            size = self.size[at[short]]
            where = spread(self.start[at[short]], size)
            part[i] = np.bincount(
                self.post_doc[where], weights=self.post_w[where] * np.repeat(weight[short], size), minlength=part.shape[1]
            )
            if skip[i] is not None and skip[i] in self.at_id:
                part[i, self.at_id[skip[i]]] = -np.inf
        cosine = part.astype(np.float32)
        last = max(0, part.shape[1] - k)
        bound = cosine.reshape(len(count), self.blocks, BLOCK).max(2) + query @ most + 2 * _SLACK
        open_ = bound >= np.partition(cosine, last, 1)[:, last, None]
        for b in np.flatnonzero(open_.any(0)).tolist():
            block = slice(b * BLOCK, (b + 1) * BLOCK)
            if open_[:, b].all():
                cosine[:, block] += query @ dense[:, block]
            else:
                own = np.flatnonzero(open_[:, b])
                cosine[own, block] += query[own] @ dense[:, block]
        least = np.maximum(np.partition(cosine, last, 1)[:, last] - 2 * _SLACK, 1e-7)
        out = []
        for i, (first, end) in enumerate(zip((ends - count).tolist(), ends.tolist())):
            found = np.flatnonzero(cosine[i] >= least[i])
            own = first + np.flatnonzero(row[first:end] >= 0)
            value = part[i, found] + (dense[np.ix_(row[own], found)] * weight[own, None]).sum(0)
            found, value = found[value >= 1e-6], np.round(value[value >= 1e-6], 6)
            chosen = np.lexsort((self.ids[found], -value))[:k]
            out.append((found[chosen], value[chosen]))
        return out

    def nearest(self, at: np.ndarray, weight: np.ndarray, skip: int | None = None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a positive cosine but for the one with id ``skip``; exact, ties by id."""
        return self.all_nearest(np.array([len(at)]), at, weight, [skip], k)[0]

    def raws(self, texts: list[str | None], own: list[int | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(distance-weighted vote, neighbours, cosines) of each text; ``own`` are the texts' doc_ids."""
        ends = np.cumsum([len(t or "") for t in texts])
        first = 0
        while first < len(texts):
            end = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TEXT_CHARS, "right"))
            end = max(first + 1, min(first + TEXTS, end))
            for near, cosine in self.all_nearest(*self.vectors(texts[first:end]), own[first:end]):
                if not len(near):
                    yield self.empty_rate, near, cosine
                    continue
                vote = cosine / (1.05 - cosine) ** 2
                score = (vote @ self.toxic[near] + PRIOR_WEIGHT * self.empty_rate) / (vote.sum() + PRIOR_WEIGHT)
                yield float(score), near, cosine
            first = end

    def raw(self, text: str | None, own: int | None) -> tuple[float, np.ndarray, np.ndarray]:
        return next(self.raws([text], [own]))

    def scores(self, texts: list[str | None], own: list[int | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """``raws``, calibrated, by columns; a text's own label never enters its score."""
        got = list(self.raws(texts, own))
        value, near, cosine = np.array([g[0] for g in got], np.float64), [g[1] for g in got], [g[2] for g in got]
        found = np.array([len(n) > 0 for n in near], bool)
        if self.calibration is not None:
            value[found] = np.interp(value[found], *self.calibration)
        return value.clip(0.0, 1.0), near, cosine


def monotone(raw: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rising steps (score, share of toxic) fitted to equal shares of the examples."""
    steps = len(raw) // STEP_EXAMPLES
    if steps < 2:
        return None
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, steps):
        pools.append([raw[part].sum(), toxic[part].sum(), len(part)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    x = np.array([a / n for a, _, n in pools])
    # half an example of each kind keeps the ends off 0 and 1
    y = np.array([(t + 0.5) / (n + 1) for _, t, n in pools])
    return x, np.maximum.accumulate(y)


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels are never learnt from; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents to learn from, ``most`` at most, held-out ones never.

    A doc_id labelled more than once is toxic if any of its labels says so; of
    rows that repeat a doc_id one stands for it.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # of bounded size: at most ``most`` pairs of numbers
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text"), "text")).alias("one")
    return found.groupBy("doc_id").agg(one, F.max("toxic").alias("toxic")).select("doc_id", "one.text", "toxic")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [bag(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("toxic"),
                pa.array([len(a) for a, _ in made], pa.int64()),
                pa.array([a.view(np.int64) for a, _ in made], pa.list_(pa.int64())),
                pa.array([n.astype(np.int32) for _, n in made], pa.list_(pa.int32())),
            ],
            ["doc_id", "toxic", "size", "term", "tf"],
        )


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(c.flatten().to_numpy() for c in column.chunks)])


def _model(rows: pa.Table) -> Model:
    """The model of ``rows`` (doc_id, toxic, size, term, tf), one an example in any order."""
    ids, toxic, size = (rows[c].to_numpy() for c in ("doc_id", "toxic", "size"))
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    postings = np.repeat(place, size), _flat(rows["term"], np.int64).view(np.uint64), _flat(rows["tf"], np.int32)
    return Model(ids[order], (toxic[order] > 0).astype(np.float64), *postings)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES, most_postings: int = MAX_POSTINGS) -> Model:
    """Fit on at most ``most`` labelled documents; without labels of both kinds every score is the base rate.

    What comes to the driver is the sample's features, bounded by both
    parameters: examples are taken in the order of their hashes while their
    postings fit.  The calibration is scored by tasks.
    """
    spark = docs.sparkSession
    labelled = written(examples(docs, labels, most), "labelled")
    bags = written(
        labelled.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(
            _bags, "doc_id long, toxic int, size long, term array<long>, tf array<int>"
        ),
        "bags",
    )
    sizes = bags.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, taken = 0, []
    for r in sizes:
        total += r["size"]
        if total <= most_postings or not taken:
            taken.append(r["doc_id"])
    if len(taken) < len(sizes):
        bags = bags.join(F.broadcast(spark.createDataFrame([(k,) for k in taken], "doc_id long")), "doc_id")
    model = _model(bags.toArrow())
    pa.default_memory_pool().release_unused()
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _held.take("toxicity", shared.value.forget)
        for batch in batches:
            raw = list(shared.value.raws(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([r[0] for r in raw], pa.float64()), pa.array([len(r[1]) for r in raw], pa.int64())],
                ["toxic", "raw", "near"],
            )

    # rows are few, so they are dealt out to all cores
    spread_out = labelled.select("doc_id", "text", F.col("toxic").cast("int")).repartition("doc_id")
    got = spread_out.mapInArrow(scored, "toxic int, raw double, near long").toArrow()
    shared.destroy()
    found = got["near"].to_numpy() > 0
    model.calibration = monotone(got["raw"].to_numpy()[found], (got["toxic"].to_numpy()[found] > 0).astype(np.float64))
    return model


_SCORED = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, cosine array<double>"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_ids of the nearest examples) and their cosines, a row per row.

    Whole texts are scored; null and empty texts, and texts without any known
    feature, get the rate of such examples and no evidence.  A document's own
    label never enters its score.  A null doc_id is kept and not held out.
    Rows may repeat, ties among neighbours go by doc_id, other columns are
    ignored, no rows give none.  The model is of bounded size
    (``MAX_EXAMPLES``, ``MAX_POSTINGS``) and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        _held.take("toxicity", m.forget)
        for batch in batches:
            value, near, cosine = m.scores(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(value),
                    pa.array((value >= threshold).astype(np.int32)),
                    pa.array([m.ids[n].tolist() for n in near], pa.list_(pa.int64())),
                    pa.array([c.tolist() for c in cosine], pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "score", "predicted", "evidence", "cosine"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(each, _SCORED)


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        _held.take("toxicity", shared.value.forget)
        for texts, ids in batches:
            few = (slice(k, k + _ROWS) for k in range(0, len(texts), _ROWS))
            value = [shared.value.scores(texts[s].to_pylist(), ids[s].to_pylist())[0] for s in few]
            yield pa.array(np.concatenate([np.zeros(0), *value]))

    return docs.where(scored("text", F.col("doc_id").cast("long")) < threshold)
