"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over bins of its values, and so
have a few pairs of features.  The tables are learnt by cyclic boosting: in
turn, each feature (then each pair) gets a shallow tree fitted to what the sum
so far leaves unexplained, and the tree's leaves are added to its table.
Scoring a batch finds the bins of all its texts and adds up table entries.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: Labelled documents the model is fitted on at most, the lowest by a hash of doc_id.
MAX_EXAMPLES = 20_000
#: Bins of a feature, and of each side of a pair.
BINS = 32
PAIR_BINS = 8
#: Pairs that get a table: those whose best quadrants explain most of what single features leave.
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.1
#: Added to a leaf's weight; examples that a leaf has at least.
SMOOTHING = 1.0
LEAF_EXAMPLES = 5
THRESHOLD = 0.3
#: Residue of the checksum of doc_id that is held out.
FOLDS = 5

FEATURES = (
    "log_words",
    "word_bytes",
    "symbols",
    "bars",
    "bangs",
    "capitals",
    "stutters",
    "distinct",
    "top_word",
    "repeated_windows",
    "repeated_lines",
    "log_line_words",
    "sentence_ends",
    "commas",
    "digits",
    "short_words",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>=@^~_\\{}[]+", np.uint8)
_ENDS = np.frombuffer(b".?;:", np.uint8)


def measure(text: bytes | None) -> np.ndarray:
    """The features of a whole text in UTF-8; zeros without words.

    Shares are of words unless they are of letters (``capitals``), of 3-word
    windows or of lines.
    """
    words = (text or b"").split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = bytes_[65:91].sum(), bytes_[97:123].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = n - 2
    distinct = len(set(zip(words, words[1:], words[2:]))) if windows > 0 else 0
    lengths = np.fromiter(map(len, words), np.int64, n)
    return np.array(
        [
            math.log1p(n),
            lengths.mean(),
            bytes_[_SYMBOLS].sum() / n,
            bytes_[ord("|")] / n,
            bytes_[ord("!")] / n,
            upper / max(upper + lower, 1),
            sum(map(operator.eq, words, words[1:])) / n,
            len(set(words)) / n,
            max(Counter(words).values()) / n,
            1 - distinct / windows if windows > 0 else 0,
            1 - len(set(lines)) / len(lines),
            math.log1p(n / len(lines)),
            bytes_[_ENDS].sum() / n,
            bytes_[ord(",")] / n,
            bytes_[48:58].sum() / n,
            (lengths <= 3).mean(),
        ]
    )


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTHING)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best (gain, place) of cutting the bins in two; place 0 where no cut leaves enough examples on both sides."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    better = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    better = np.where((nl >= LEAF_EXAMPLES) & (n.sum() - nl >= LEAF_EXAMPLES), better, 0)
    if not len(better) or better.max() <= 0:
        return 0.0, 0
    return float(better.max()), int(better.argmax()) + 1


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A value for each bin: leaves of a tree of ``depth`` over ordered bins of gradients, weights and counts."""
    gain, at = _cut(g, h, n) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + SMOOTHING))
    return np.concatenate([tree(a, b, c, depth - 1) for a, b, c in ((g[:at], h[:at], n[:at]), (g[at:], h[at:], n[at:]))])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts one axis of a grid, then the other on both sides."""
    best = (-1.0, np.full(g.shape, g.sum() / (h.sum() + SMOOTHING)))
    for axis in (0, 1):
        a, b, c = (x if axis == 0 else x.T for x in (g, h, n))
        for at in range(1, a.shape[0]):
            gain, values = 0.0, []
            for rows in (slice(None, at), slice(at, None)):
                ga, hb, nc = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
                gain += _gain(ga.sum(), hb.sum()) + _cut(ga, hb, nc)[0]
                values.append(np.tile(tree(ga, hb, nc, 1), (len(a[rows]), 1)))
            if gain > best[0]:
                out = np.concatenate(values)
                best = (gain, out if axis == 0 else out.T)
    return best


@dataclass
class Model:
    """Bin edges, tables and the base of the sum; a few thousand numbers, whatever the corpus."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)] * len(FEATURES))
    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1)] * len(FEATURES))
    #: Bin -> coarse bin of the pairs, for each feature.
    coarse: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1, np.int64)] * len(FEATURES))
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def terms(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each table adds for each row of features."""
        bins = self.bins(x)
        out = {FEATURES[k]: t[bins[k]] for k, t in enumerate(self.tables)}
        for (i, j), t in self.pairs.items():
            out[f"{FEATURES[i]} x {FEATURES[j]}"] = t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        margin = self.base + sum(self.terms(x).values())
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on rows of features and labels 0/1; without both labels every score is the smoothed base rate."""
    model = Model(base=math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not 0 < y.sum() < len(y):
        return model
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    # values that hold many quantiles are bins of their own
    model.edges = [np.unique(np.quantile(x[:, k], cuts, method="lower")) for k in range(x.shape[1])]
    model.edges = [np.unique(np.concatenate([e, np.nextafter(e, np.inf)])) for e in model.edges]
    bins, sizes = model.bins(x), [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(len(y), model.base)

    def summed(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size), np.bincount(at, minlength=size)

    for _ in range(ROUNDS):
        for k, at in enumerate(bins):
            step = RATE * tree(*summed(at, sizes[k]))
            model.tables[k] += step
            margin += step[at]

    model.coarse = [_coarse(np.bincount(b, minlength=s)) for b, s in zip(bins, sizes)]
    small = [c[b] for c, b in zip(model.coarse, bins)]
    width = [int(c.max()) + 1 for c in model.coarse]
    spot = lambda i, j: small[i] * width[j] + small[j]
    grid = lambda i, j: [v.reshape(width[i], width[j]) for v in summed(spot(i, j), width[i] * width[j])]
    gains = {}
    for i, j in combinations(range(len(bins)), 2):
        g, h, n = grid(i, j)
        gains[i, j] = pair_tree(g, h, n)[0] - _gain(g.sum(), h.sum())
    model.pairs = {p: np.zeros((width[p[0]], width[p[1]])) for p in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = RATE * pair_tree(*grid(i, j))[1]
            table += step
            margin += step.ravel()[spot(i, j)]
    return model


def _coarse(n: np.ndarray) -> np.ndarray:
    """Bins -> at most ``PAIR_BINS`` coarse bins of about equal counts."""
    before = np.cumsum(n) - n
    found = before * PAIR_BINS // max(n.sum(), 1)
    return np.unique(np.minimum(found, PAIR_BINS - 1), return_inverse=True)[1]


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels are never learnt from, and for a null doc_id, which has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def examples(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, text, quality) to learn from, ``most`` doc_ids at most, held-out ones never.

    A doc_id with several labels is 1 if any of them is; of rows that repeat a
    doc_id the one whose text is smallest by hash stands for it.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # of bounded size: at most ``most`` pairs of numbers
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text"), "text")).alias("one")
    return found.groupBy("doc_id").agg(one, F.max("quality").alias("quality")).select("doc_id", "one.text", "quality")


def _measured(column: pa.Array) -> np.ndarray:
    found = [measure(t.as_py()) for t in column]
    return np.array(found) if found else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> Model:
    """Fit on at most ``most`` labelled documents of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    Tasks measure the sample; its features, ``most`` rows of 16 numbers, come
    to the driver.  Null texts count as empty.  Without labels scores are one
    half.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _measured(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "x"])

    chosen = examples(docs, labels, most).select("doc_id", F.col("quality").cast("int"), F.col("text").cast("binary"))
    rows = written(chosen.mapInArrow(each, "doc_id long, quality int, x array<double>"), "measured").toArrow()
    rows = rows.sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return learn(x, (rows["quality"].to_numpy() > 0).astype(np.float64))


_SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= ``threshold``) for every row of ``docs`` (doc_id, text).

    Whole texts are measured.  Null, empty and blank texts have all features
    zero and are scored by the tables like any other.  Rows may repeat, a null
    doc_id is kept and counts as held out, no rows give none, other columns
    are ignored.  The model is a few thousand numbers and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = shared.value.score(_measured(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, _SCORED)
