"""Spelling variants: words of a vocabulary at one edit, by composing acceptors.

The vocabulary is an acyclic acceptor V; words at one edit are what
``V o E o V`` accepts, where E copies code points, edits one and copies on.
The composition is cut at its initial states: E has copied the code points
before the edit, so both words have brought V to one state, and it will copy
those after it.  A partition therefore holds the words that agree before or
after the part that may be edited.  ``lo <= edit < hi`` are the places it
answers for, in words whose shorter one has ``size`` code points; every
partition's words become minimal acceptors, one for each length, which are
composed with E from the initial state.

The edit of a pair is the first place where its words differ, so a pair
belongs to exactly one partition.  Partitions of too many words are halved,
down to one place, where at most the square of the alphabet is left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
#: One occurrence group in so many loses a code point.
DELETE_EVERY = 31
#: A form has this many times the occurrences of its word.
FORM_RATIO = 10
#: Words of a partition; more are halved.  At one place a partition has at most alphabet + alphabet ** 2, about 16,000.
PARTITION_WORDS = 20_000
#: Places that an acceptor is built for at a time.
SPAN = 24
#: Distinct words that a task holds before it hands counts on.
HELD_WORDS = 400_000


def runs(text: bytes, min_length: int) -> list[str]:
    """Maximal runs of letters of at least ``min_length`` in UTF-8 text, A-Z lower-cased."""
    # lower() of bytes changes A-Z alone
    return re.findall(f"[{LETTERS}]{{{max(min_length, 1)},}}", text.lower().decode("utf-8", "surrogatepass"))


def spelled(run: str, named: int, every: int = DELETE_EVERY) -> str:
    """The run, or for one in ``every`` by the checksum of ``doc_id:run`` the run without one code point.

    ``named`` is the checksum of ``doc_id:``.
    """
    h = zlib.crc32(run.encode(), named)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = DELETE_EVERY) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and their occurrences.

    Counts are combined in tasks before they meet by word.  A null text has no
    words, a null doc_id is the empty text in the checksum, repeated rows count
    each time.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def made() -> pa.RecordBatch:
            words, n = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                named = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs(text.as_py(), min_length)).items():
                    word = spelled(run, named, every)
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield made()
        yield made()

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    found = rows.mapInArrow(each, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Add ``key``: what all words of the partition (size, lo, hi) have in common."""
    after = F.greatest(F.col("size") - F.col("hi"), F.lit(0))
    ends = F.expr("substring(word, char_length(word) - greatest(size - hi, 0) + 1)")
    key = F.concat_ws(
        ":", "size", "lo", "hi", F.expr("substring(word, 1, lo)"), F.when(after > 0, ends).otherwise("")
    )
    return rows.withColumn("key", key)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, for the first and the second half of its places."""
    middle = F.expr("(lo + hi) div 2").cast("int")
    both = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return _keyed(rows.select("word", "n", "size", F.explode(both).alias("half")).select("word", "n", "size", "half.*"))


def partitions(words: DataFrame, min_length: int = MIN_LENGTH, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, n, size, lo, hi, key): every word in the partitions of all its edits.

    A word of length L is the shorter one (or as long) of some pairs, size L,
    and the longer one of others, size L - 1.
    """
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).where(F.col("size") >= min_length)
    whole = rows.select("word", "n", "size", F.lit(0).alias("lo"), (F.col("size") + 1).alias("hi"))
    todo, done = _halves(whole), None
    while True:
        crowded = todo.groupBy("key", "lo", "hi").count().where(f"count > {most} AND hi - lo > 1").select("key")
        crowded = written(crowded, "crowded")
        if crowded.isEmpty():
            return todo if done is None else done.unionByName(todo)
        small = todo.join(crowded, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        todo = written(_halves(todo.join(crowded, "key")), "halves")


class Acceptor:
    """Minimal acyclic acceptor of distinct strings of one length; states are numbers, 0 is final."""

    def __init__(self, strings: list[str]) -> None:
        """``strings`` are sorted."""
        self.arcs: list[dict[str, int]] = [{}]
        self._known: dict[tuple, int] = {}
        self.length = len(strings[0]) if strings else 0
        self._suffixes: dict[int, tuple[str, ...]] = {0: ("",)}
        self.start = self._state(strings, 0, len(strings), 0) if strings else None

    def _state(self, strings: list[str], a: int, b: int, depth: int) -> int:
        """The state whose right language is ``strings[a:b]`` from ``depth`` on; equal languages are one state."""
        if depth == self.length:
            return 0
        arcs, at = {}, a
        while at < b:
            letter, end = strings[at][depth], at + 1
            while end < b and strings[end][depth] == letter:
                end += 1
            arcs[letter] = self._state(strings, at, end, depth + 1)
            at = end
        name = tuple(arcs.items())
        if name not in self._known:
            self._known[name] = len(self.arcs)
            self.arcs.append(arcs)
        return self._known[name]

    def suffixes(self, state: int) -> tuple[str, ...]:
        """The right language of a state."""
        if state not in self._suffixes:
            found = [x + t for x, to in self.arcs[state].items() for t in self.suffixes(to)]
            self._suffixes[state] = tuple(found)
        return self._suffixes[state]


class Composition:
    """Acceptor, one-edit transducer and acceptor again; the words of both differ by one replacement or insertion."""

    def __init__(self, short: Acceptor, long: Acceptor, same: bool) -> None:
        """``same``: both are one acceptor and the edit replaces; else it inserts and ``long`` has one place more."""
        self.short, self.long, self.same = short, long, same
        self._common: dict[tuple[int, int], tuple[str, ...]] = {}
        self._edits: dict[tuple[int, int], list[tuple[str, str]]] = {}
        self._live: dict[tuple[int, int], bool] = {}

    def common(self, p: int, q: int) -> tuple[str, ...]:
        """What both right languages accept after the edit."""
        if p == q and self.same:
            return self.short.suffixes(p)
        if (p, q) not in self._common:
            if not p or not q:
                found = [""] if not p and not q else []
            else:
                after = self.long.arcs[q]
                found = [x + t for x, to in self.short.arcs[p].items() if x in after for t in self.common(to, after[x])]
            self._common[p, q] = tuple(found)
        return self._common[p, q]

    def edits(self, p: int, q: int) -> list[tuple[str, str]]:
        """The pairs of endings whose words first differ at these states."""
        if (p, q) not in self._edits:
            mine, its = self.short.arcs[p], self.long.arcs[q]
            found = []
            if self.same:
                letters = list(mine)
                for i, x in enumerate(letters):
                    for y in letters[i + 1 :]:
                        found += [(x + t, y + t) for t in self.common(mine[x], mine[y])]
            else:
                for y, to in its.items():
                    if not p and not to:
                        found.append(("", y))
                    after = self.long.arcs[to]
                    for x, here in mine.items():
                        if x != y and x in after:
                            found += [(x + t, y + x + t) for t in self.common(here, after[x])]
            self._edits[p, q] = found
        return self._edits[p, q]

    def live(self, p: int, q: int, depth: int) -> bool:
        """Whether a pair differs here or later, ``depth`` places on at most."""
        if (p, q) not in self._live:
            # states of one acceptor have one depth, so the answer is the state's own
            its = self.long.arcs[q]
            self._live[p, q] = bool(self.edits(p, q)) or depth > 1 and any(
                x in its and self.live(to, its[x], depth - 1) for x, to in self.short.arcs[p].items()
            )
        return self._live[p, q]

    def pairs(self, depth: int) -> Iterator[tuple[str, str]]:
        """The accepted pairs whose edit is at one of the first ``depth`` places."""
        if self.short.start is None or self.long.start is None:
            return
        stack = [(self.short.start, self.long.start, "", depth)]
        while stack:
            p, q, copied, left = stack.pop()
            if left < 1 or not self.live(p, q, left):
                continue
            for a, b in self.edits(p, q):
                yield copied + a, copied + b
            its = self.long.arcs[q]
            stack += [(to, its[x], copied + x, left - 1) for x, to in self.short.arcs[p].items() if x in its]


def near_pairs(words: list[str], size: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """Pairs of ``words`` at one edit at the places lo <= edit < hi of a shorter word of ``size``.

    All words begin with the same ``lo`` and end with the same ``size - hi``
    code points and are distinct; lengths are ``size`` and ``size + 1``.
    """
    if len(words) < 2 or all(len(w) > size for w in words):
        return
    if hi - lo > SPAN:
        middle = (lo + hi) // 2
        for a, b in ((lo, middle), (middle, hi)):
            after = max(size - b, 0)
            key = lambda w: (w[lo:a], w[len(w) - after : len(w) - max(size - hi, 0)])  # noqa: B023, E731
            for _, part in groupby(sorted(words, key=key), key):
                yield from near_pairs(list(part), size, a, b)
        return
    after = max(size - hi, 0)
    ends = words[0][len(words[0]) - after :]
    start = words[0][:lo]
    short, long = (sorted(w[lo : len(w) - after] for w in words if len(w) == n) for n in (size, size + 1))
    one = Acceptor(short)
    for a, b in Composition(one, one, True).pairs(hi - lo):
        yield start + a + ends, start + b + ends
    if long:
        for a, b in Composition(one, Acceptor(long), False).pairs(hi - lo):
            yield start + a + ends, start + b + ends


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, near, near_n): every ordered pair of ``words`` (word, n; distinct) at one edit."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["word", "near", "near_n"])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "size", "lo", "hi")))

        found: list[tuple] = []
        for _, part in groupby(rows(), lambda r: r[0]):
            group = list(part)
            if len(group) < 2:
                continue
            n = {r[1]: r[2] for r in group}
            for a, b in near_pairs(list(n), *group[0][3:]):
                found += [(a, b, n[b]), (b, a, n[a])]
                if len(found) >= 100_000:
                    yield made(found)
                    found = []
        yield made(found)

    dealt = partitions(words, min_length, most).select("key", "word", "n", "size", "lo", "hi")
    ordered = dealt.repartition("key").sortWithinPartitions("key", "word")
    return ordered.mapInArrow(each, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): its form's form and so on.

    Counts grow along forms, so there are no cycles; every round doubles the steps.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if steps.join(further, "root", "left_semi").isEmpty():
            return steps
        steps = written(
            steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots"
        )


def group_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    every: int = DELETE_EVERY,
    ratio: int = FORM_RATIO,
    most: int = PARTITION_WORDS,
) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of ``docs`` (doc_id, text).

    Words near each other differ by exactly one inserted, deleted or replaced
    code point.  The form is the near word of largest n (ties: smallest in
    code-point order) if it has ``ratio`` times the word's n; the root follows
    forms to the last.  Null and empty texts have no words, rows that repeat
    count each time, an empty table gives no rows, other columns are ignored.
    """
    words = written(vocabulary(docs, min_length, min_count, every), "vocabulary")
    near = near_words(words, min_length, most)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= F.col("n") * ratio
    judged = words.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    judged = written(judged, "judged")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
