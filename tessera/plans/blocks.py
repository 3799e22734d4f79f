"""Links between the rows of a block, found by one task a block: as many as rows, whatever the titles have in common."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Titles of a block beyond which pairs are first narrowed by the characters that both have.
COUNTED = 48
#: From this length on difflib leaves out frequent characters.
AUTOJUNK = 200

LINKS = "i long, j long, block_first long, published_i boolean, published_j boolean"


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common run, first in ``a``, then in ``b``, and so on at both of its sides."""
    total, open_pairs = 0, [(a, b)]
    while open_pairs:
        x, y = open_pairs.pop()
        n, best, at = len(x), 0, 0
        if not y:
            continue
        i = 0
        while i + best < n:
            if x[i : i + best + 1] in y:
                best, at = best + 1, i
                while i + best < n and x[i : i + best + 1] in y:
                    best += 1
            i += 1
        if best:
            total += best
            j = y.find(x[at : at + best])
            open_pairs.append((x[:at], y[:j]))
            open_pairs.append((x[at + best :], y[j + best :]))
    return total


def judge(least: float, contained: bool) -> Callable[[str | None, str | None], bool]:
    """Whether two titles, that of the earlier row first, go together: by their ratio or, if ``contained``, as one contains the other."""

    def passes(a: str | None, b: str | None) -> bool:
        if a is None or b is None:
            return False
        if contained and (a in b or b in a):
            return True
        both = len(a) + len(b)
        if not both or 2.0 * min(len(a), len(b)) / both < least:
            return False
        if len(b) >= AUTOJUNK:
            return difflib.SequenceMatcher(None, a, b).ratio() >= least
        return 2.0 * matched(a, b) / both >= least

    return passes


class _Bags:
    """Characters of titles, counted: what two titles can have in common at most."""

    def __init__(self, titles: list[str | None], least: float) -> None:
        spelt = [t or "" for t in titles]
        number = {c: k for k, c in enumerate(sorted(set("".join(spelt))))}
        self.least, self.n = least, np.array([len(t) for t in spelt])
        self.counts = np.zeros((len(spelt), len(number)), np.int32)
        for row, t in zip(self.counts, spelt):
            for c in t:
                row[number[c]] += 1

    def near(self, a: int, others: np.ndarray) -> np.ndarray:
        common = np.minimum(self.counts[others], self.counts[a]).sum(1)
        n = self.n[others]
        return others[(2.0 * common >= self.least * (n + self.n[a]) - 1e-9) | (common == np.minimum(n, self.n[a]))]


def title_links(pos: list[int], held: list[bool], titles: list[str | None], passes: Callable, least: float) -> list[tuple[int, int]]:
    """(x, y): places of an earlier and a later row: the links of a block, of all pairs that pass, which ordered unions can need.

    ``pos`` ascends.  Links are tried by (i, j) and never join two groups with
    a held row, so a pair is left out if earlier pairs of the block, or held
    rows, which count as one group, already join its ends.  What stays: each
    later row of a title goes to the earliest row of another title before all
    of its own that passes, else to the first of its own; first rows, to the
    earliest such row and by what is left of their pairs.
    """
    places: dict[str | None, list[int]] = {}
    for k, t in enumerate(titles):
        places.setdefault(t, []).append(k)
    rows, names = list(places.values()), list(places)
    m, first = len(rows), [r[0] for r in rows]
    out = []
    up = [-1] * m
    if m > 1:
        out = _between_titles(pos, held, rows, names, first, up, passes, least)
    for b, own in enumerate(rows):
        to = first[b] if up[b] < 0 else first[up[b]]
        out += [(to, y) for y in own[1:] if pos[to] != pos[y] and not (held[to] and held[y])]
    return out


def _between_titles(pos, held, rows, names, first, up, passes, least) -> list[tuple[int, int]]:
    """Links of the titles' first rows, and of later rows to titles that pass in their direction only; fills ``up``."""
    m, out = len(rows), []
    at = [pos[f] for f in first]
    # group 0 is that of all held rows
    group = [0 if held[f] else k + 1 for k, f in enumerate(first)]
    members = {k: [] for k in range(m + 1)}
    for k, g in enumerate(group):
        members[g].append(k)
    groups, unmet = len(set(group)), m - 1
    wide = m > COUNTED
    if wide:
        bags, group_of, ups, starts = _Bags(names, least), np.array(group), np.array(up), np.array(at)
        lasts = np.array([pos[r[-1]] for r in rows])

    def join(a: int, b: int) -> None:
        nonlocal groups
        x, y = group[a], b
        if x == y:
            return
        if not x or (y and len(members[x]) > len(members[y])):
            x, y = y, x
        if wide:
            group_of[members[x]] = y
        for k in members[x]:
            group[k] = y
        # no title may be in the group of held rows yet
        groups -= bool(members[x]) and bool(members[y])
        members[y] += members.pop(x)

    for a in range(m):
        if wide:
            apart = group_of != group[a]
            ahead = (starts > at[a]) & (apart | (ups < 0))
            some = np.flatnonzero(ahead | ((starts < at[a]) & (lasts > at[a]) & apart))
            some = bags.near(a, some).tolist()
        else:
            some = [b for b in range(m) if at[b] != at[a] and (group[b] != group[a] or (b > a and up[b] < 0))]
        for b in some:
            if at[b] > at[a]:
                if (up[b] >= 0 and group[a] == group[b]) or not passes(names[a], names[b]):
                    continue
                new = up[b] < 0
                if new:
                    up[b], unmet = a, unmet - 1
                    if wide:
                        ups[b] = a
                if not (held[first[a]] and held[first[b]]) and (new or group[a] != group[b]):
                    out.append((first[a], first[b]))
                    join(a, group[b])
            elif group[a] != group[b]:
                later = next((y for y in rows[b] if pos[y] > at[a]), None)
                if later is not None and passes(names[a], names[b]):
                    out.append((first[a], later))
                    join(a, group[b])
        # from here on a held row of the title has been tried with the title's first
        if len(rows[a]) > 1 and group[a] and any(held[y] for y in rows[a][1:]):
            join(a, 0)
        if groups == 1 and not unmet:
            break
    return out


def fact_links(pos: list[int], held: list[bool], facts: list) -> list[tuple[int, int]]:
    """(x, y): the first row of equal ``facts`` and each other one; rows without are left out."""
    first: dict = {}
    out = []
    for y, f in enumerate(facts):
        if f is not None:
            x = first.setdefault(f, y)
            if pos[x] != pos[y] and not (held[x] and held[y]):
                out.append((x, y))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks: runs of equal ``block``, cut where one ends."""
    open_rows: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if open_rows and open_rows[-1].column("block")[-1].as_py() != batch.column("block")[0].as_py():
            yield pa.Table.from_batches(open_rows)
            open_rows = []
        names = batch.column("block")
        ends = np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False))
        if len(ends):
            cut = int(ends[-1]) + 1
            yield pa.Table.from_batches([*open_rows, batch.slice(0, cut)])
            open_rows = [batch.slice(cut)]
        else:
            open_rows.append(batch)
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def links(least: float, contained: bool, with_facts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows (block, pos, published, title) in the order of block and pos, to ``LINKS``.

    With facts, rows also have ``fact`` (null: none), and titles that are null
    or blank do not count.
    """
    passes = judge(least, contained)

    def of_block(pos: list, held: list, titles: list, facts: list | None) -> list[tuple[int, int]]:
        if facts is None:
            return title_links(pos, held, titles, passes, least)
        at = [k for k, t in enumerate(titles) if t]
        if len(at) == len(titles):
            found = title_links(pos, held, titles, passes, least)
        else:
            spelt = title_links([pos[k] for k in at], [held[k] for k in at], [titles[k] for k in at], passes, least)
            found = [(at[x], at[y]) for x, y in spelt]
        more = fact_links(pos, held, facts)
        return list(dict.fromkeys(found + more)) if more else found

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            table = table.combine_chunks()
            names = table.column("block").combine_chunks()
            new = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], new]))
            sizes = np.diff(np.append(starts, len(names)))
            many = sizes > 1
            if not many.any():
                continue
            kept = np.repeat(many, sizes)
            table = table.filter(pa.array(kept))
            pos, held = table.column("pos").to_numpy(), table.column("published").to_numpy()
            columns = [pos.tolist(), held.tolist(), table.column("title").to_pylist(), table.column("fact").to_pylist() if with_facts else None]
            xs, ys, firsts, s = [], [], [], 0
            for size in sizes[many].tolist():
                e = s + size
                for x, y in of_block(*(c and c[s:e] for c in columns)):
                    xs.append(s + x)
                    ys.append(s + y)
                    firsts.append(s)
                s = e
            x, y = np.array(xs, np.int64), np.array(ys, np.int64)
            out = [pos[x], pos[y], pos[np.array(firsts, np.int64)], held[x], held[y]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["i", "j", "block_first", "published_i", "published_j"])

    return each
