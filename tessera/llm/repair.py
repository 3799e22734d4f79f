"""Token-id files compressed with a Re-Pair grammar.

A shard is a run of documents in ascending doc_id order.  Frequent pairs of
neighbouring ids are replaced by nonterminals, round after round, never across
a document's end, until no pair occurs ``MIN_COUNT`` times; the rules, the
expanded length of every nonterminal and the place of every document are
stored, so one document, or the ids from any position on, are decoded without
the rest.

File: ``REPAIR02``, then little-endian unsigned 64-bit counts (documents,
terminals' bound, rules, rounds, symbols, bits a symbol), then the arrays
``doc_id`` i8, ``has_id`` u1, ``doc_symbols`` u4, ``doc_tokens`` u4,
``round_rules`` u4, ``rule_left`` u4, ``rule_right`` u4, ``rule_length`` u4,
the symbols' low 16 bits u2 and one bit plane for each bit above them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _files
from tessera.llm._tokens import encoder, spread
from tessera.session import scratch, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: Ids after which a shard is closed; a longer document is a shard of its own.
SHARD_TOKENS = 2_000_000
#: A pair must occur this often in a shard to become a rule, whose two ids and length take the room of six symbols.
MIN_COUNT = 8
#: Tasks that files are dealt to for reading, at most.
READ_TASKS = 20_000
MAGIC = b"REPAIR02"
_ARRAYS = (
    ("doc_id", "<i8"), ("has_id", "u1"), ("doc_symbols", "<u4"), ("doc_tokens", "<u4"),
    ("round_rules", "<u4"), ("rule_left", "<u4"), ("rule_right", "<u4"), ("rule_length", "<u4"),
)
#: Bits of the table of hashed counts, which should fit a core's cache; results do not depend on it.
_SLOT_BITS = 20


def _frequent(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted pair codes that occur ``least`` times, places that hold one, which one); exact.

    A table of hashed counts tells which places can hold a frequent pair; only
    those are sorted, each as one number of pair and place where that fits.
    """
    code = left.astype(np.uint64) << np.uint64(32) | right
    if len(code) > 1 << _SLOT_BITS - 4:
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int32)
        at = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOT_BITS) >= least)[slot])
    else:
        at = np.arange(len(code))
    if not len(at):
        return code[:0], at, at
    bits = int(max(left.max(), right.max())).bit_length()
    places = len(code).bit_length()
    if 2 * bits + places <= 64:
        key = np.sort((left[at].astype(np.uint64) << np.uint64(bits) | right[at]) << np.uint64(places) | at.astype(np.uint64))
        order = (key & np.uint64((1 << places) - 1)).astype(np.int64)
        key >>= np.uint64(places)
    else:
        order = at[np.argsort(code[at], kind="stable")]
        key = code[order]
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    counts = np.diff(np.append(first, len(key)))
    often = counts >= least
    number = np.where(often, np.cumsum(often) - 1, -1)
    which = np.repeat(number, counts)
    held = which >= 0
    back = np.sort(order[held] << 32 | which[held])
    return code[order[first[often]]], back >> 32, back & 0xFFFFFFFF


def compress(symbols: np.ndarray, ends: np.ndarray, vocabulary: int, least: int = MIN_COUNT) -> dict:
    """Grammar of one shard: symbols and document lengths become arrays of the file format.

    ``ends`` are the positions after each document.  Every round replaces all
    pairs that occur ``least`` times; in a run of overlapping occurrences
    every second one from the left is taken.  A pair taken less often, because
    its neighbours were, waits for the next round.  Only pairs that were
    frequent and those beside a replaced one can be frequent in the next
    round, so only they are counted again.  Rounds end when there is none.
    """
    n = len(symbols)
    symbol = np.append(symbols, 0).astype(np.uint32)
    follows = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    # no pair starts at a document's last symbol
    last = np.zeros(n + 1, bool)
    last[ends[ends > 0] - 1] = True
    last[n:] = True
    alive = np.ones(n, bool)
    active = np.flatnonzero(~last[:n])
    lefts, rights, per_round = [], [], []
    next_symbol = vocabulary
    while len(active):
        pairs, where, which = _frequent(symbol[active], symbol[follows[active]], least)
        if not len(pairs):
            break
        at = active[where]
        starts = np.ones(len(at), bool)
        starts[1:] = follows[at[:-1]] != at[1:]
        first = np.flatnonzero(starts)
        run = np.repeat(first, np.diff(np.append(first, len(at))))
        take = (np.arange(len(at)) - run) % 2 == 0
        taken = np.bincount(which[take], minlength=len(pairs))
        chosen = taken >= least
        if not chosen.any():
            chosen = taken == taken.max()
        take &= chosen[which]
        number = np.cumsum(chosen) - 1
        new, gone = at[take], follows[at[take]]
        symbol[new] = next_symbol + number[which[take]]
        last[new] = last[gone]
        follows[new] = follows[gone]
        before[follows[new]] = new
        alive[gone] = False
        pairs = pairs[chosen]
        lefts.append((pairs >> np.uint64(32)).astype(np.uint32))
        rights.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        per_round.append(len(pairs))
        next_symbol += len(pairs)
        near = np.concatenate([at, before[new][before[new] >= 0]])
        near = near[alive[near] & ~last[near]]
        if len(near) > n >> 5:
            changed = np.zeros(n, bool)
            changed[near] = True
            active = np.flatnonzero(changed)
        else:
            active = np.unique(near)
    left = np.concatenate([np.zeros(0, np.uint32), *lefts])
    right = np.concatenate([np.zeros(0, np.uint32), *rights])
    length = np.ones(vocabulary + len(left), np.uint32)
    at = vocabulary
    for k in per_round:
        rules = slice(at - vocabulary, at - vocabulary + k)
        length[at : at + k] = length[left[rules]] + length[right[rules]]
        at += k
    until = np.concatenate([[0], np.cumsum(alive)])[ends]
    return {
        "vocabulary": vocabulary, "doc_symbols": np.diff(until, prepend=0), "doc_tokens": np.diff(ends, prepend=0), "round_rules": np.array(per_round, np.int64),
        "rule_left": left, "rule_right": right, "rule_length": length[vocabulary:], "symbols": symbol[:n][alive],
    }


def expand_all(grammar: dict) -> np.ndarray:
    """Ids of all symbols: every rule is written out once, then every symbol is looked up."""
    vocabulary = grammar["vocabulary"]
    size = np.append(np.ones(vocabulary, np.int64), grammar["rule_length"])
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    flat[:vocabulary] = np.arange(vocabulary)
    at = vocabulary
    for n in grammar["round_rules"].tolist():
        k = slice(at - vocabulary, at - vocabulary + n)
        parts = np.stack([grammar["rule_left"][k], grammar["rule_right"][k]], 1).ravel()
        flat[start[at] : start[at + n - 1] + size[at + n - 1]] = flat[spread(start[parts], size[parts])]
        at += n
    symbols = grammar["symbols"]
    return flat[spread(start[symbols], size[symbols])]


def expand(grammar: dict, symbols: np.ndarray) -> np.ndarray:
    """Ids of a run of symbols, the youngest rules first."""
    bound = grammar["vocabulary"] + int(grammar["round_rules"].sum())
    out = symbols.astype(np.uint32)
    for n in grammar["round_rules"][::-1].tolist():
        bound -= n
        inner = out >= bound
        if not inner.any():
            continue
        size = inner.astype(np.int64) + 1
        begin = np.cumsum(size) - size
        rule = out[inner] - grammar["vocabulary"]
        out = np.repeat(out, size)
        out[begin[inner]] = grammar["rule_left"][rule]
        out[begin[inner] + 1] = grammar["rule_right"][rule]
    return out


def document(grammar: dict, k: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of document ``k``; only the symbols that hold them are expanded."""
    end = int(grammar["doc_symbols"][: k + 1].sum())
    symbols = grammar["symbols"][end - int(grammar["doc_symbols"][k]) : end]
    size = np.where(symbols < grammar["vocabulary"], 1, np.append(grammar["rule_length"], 1)[np.maximum(symbols.astype(np.int64) - grammar["vocabulary"], 0)])
    until = np.cumsum(size)
    total = int(until[-1]) if len(until) else 0
    stop = total if count is None else min(total, start + count)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = np.searchsorted(until, start, "right"), np.searchsorted(until, stop, "left")
    skipped = int(until[a] - size[a])
    return expand(grammar, symbols[a : b + 1])[start - skipped : stop - skipped]


def dump(grammar: dict, stream) -> int:
    """Write a grammar with ``doc_id`` and ``has_id``; returns the bytes written."""
    bits = max(16, int(grammar["vocabulary"] + len(grammar["rule_left"])).bit_length())
    symbols = grammar["symbols"]
    counts = (len(grammar["doc_id"]), grammar["vocabulary"], len(grammar["rule_left"]), len(grammar["round_rules"]), len(symbols), bits)
    parts = [MAGIC, struct.pack("<6Q", *counts)]
    parts += [np.ascontiguousarray(grammar[name]).astype(kind).tobytes() for name, kind in _ARRAYS]
    parts.append((symbols & 0xFFFF).astype("<u2").tobytes())
    parts += [np.packbits((symbols >> b & 1).astype(bool)).tobytes() for b in range(16, bits)]
    for p in parts:
        stream.write(p)
    return sum(map(len, parts))


def load_head(data: bytes) -> tuple[dict, int, int, int]:
    """(grammar without symbols, place of the symbols, their number, bits each) of the first bytes of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a Re-Pair file")
    docs, vocabulary, rules, rounds, symbols, bits = struct.unpack_from("<6Q", data, 8)
    out, at = {"vocabulary": vocabulary}, 56
    for (name, kind), n in zip(_ARRAYS, (docs, docs, docs, docs, rounds, rules, rules, rules)):
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes
    return out, at, symbols, bits


def load(data: bytes) -> dict:
    """The grammar of a file."""
    out, at, n, bits = load_head(data)
    symbols = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    at += 2 * n
    for b in range(16, bits):
        symbols |= np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(np.uint32) << np.uint32(b)
        at += -(-n // 8)
    out["symbols"] = symbols
    return out


def _write(path: str, folder: str, end_id: int, shard_tokens: int):
    from pyspark import TaskContext

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        vocabulary = max(tokens.library.get_vocab_size(), end_id + 1)
        held_ids, held_n, held_docs, total, shard = [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal held_ids, held_n, held_docs, total, shard
            n = np.concatenate(held_n)
            doc_ids = pa.concat_arrays(held_docs)
            grammar = compress(np.concatenate(held_ids), np.cumsum(n), vocabulary)
            grammar["doc_id"] = doc_ids.fill_null(0).to_numpy()
            grammar["has_id"] = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            uri, out = _files.create(folder, ".repair")
            dump(grammar, out)
            out.close()
            row = {"part": part, "shard": shard, "path": uri, "docs": len(n), "tokens": total}
            held_ids, held_n, held_docs, total, shard = [], [], [], 0, shard + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            texts = batch.column("text")
            for first, last, ids, n in tokens.batches(texts):
                ends = np.cumsum(n)
                held_ids.append(np.insert(ids, ends, end_id))
                held_n.append(n + 1)
                held_docs.append(batch.column("doc_id").slice(first, last - first))
                total += len(held_ids[-1])
                if total >= shard_tokens:
                    yield flush()
        if held_n:
            yield flush()

    return write


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards in ascending doc_id order.

    Returns the manifest: part, shard, path, docs, tokens; files go by (part,
    shard).  A null text is empty, null doc_ids come first, rows that repeat a
    doc_id stand together in the order of their texts' hashes.  No rows give
    no files.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = "part int, shard int, path string, docs long, tokens long"
    return written(ordered.mapInArrow(_write(tokenizer, folder, end_id, shard_tokens), schema), "id-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path"), batch.column("base")):
            with _files.read_stream(path.as_py()) as stream:
                grammar = load(stream.read())
            ids = expand_all(grammar).astype("<u4")
            n = grammar["doc_tokens"].astype(np.int64)
            ends = np.cumsum(n)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grammar["doc_id"], mask=grammar["has_id"] == 0),
                    pa.array(base.as_py() + ends - n),
                    pa.array(n),
                    pa.array(np.array(crc, np.int64)),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; start counts the ids of all documents before."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")
    parts = parts.select("part", before.alias("part_base"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    files = manifest.withColumn("inside", inside).join(parts, "part").select("path", (F.col("inside") + F.col("part_base")).alias("base"))
    # a stated number, because a few bytes a file would otherwise be coalesced into one task
    return files.repartition(max(1, min(manifest.count(), READ_TASKS)), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path"):
            with _files.read_stream(path.as_py()) as stream:
                docs = struct.unpack_from("<Q", stream.read(56), 8)[0]
                ids = np.frombuffer(stream.read(8 * docs), "<i8")
                has = np.frombuffer(stream.read(docs), "u1")
            known = np.flatnonzero(has)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[known]), pa.array([path.as_py()] * len(known), pa.string()), pa.array(known)], ["doc_id", "path", "place"]
            )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, grammar = None, {}
    for batch in batches:
        found = []
        for p, place, start, count in zip(*(batch.column(c).to_pylist() for c in ("path", "place", "start", "count"))):
            if p != path:
                with _files.read_stream(p) as stream:
                    path, grammar = p, load(stream.read())
            found.append(document(grammar, place, start or 0, count))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("count"), pa.array(found, pa.list_(pa.int64()))],
            ["doc_id", "start", "count", "ids"],
        )


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, start, count, ids: the ids from ``start`` on, ``count`` at most, of every wanted document.

    ``wanted`` has doc_id, start and count; a null start is 0, a null count
    the rest.  Files' heads give the documents' places; only rows of places
    are shuffled, and only the symbols that hold the ids are expanded, found
    by the expanded lengths.  A doc_id that several documents have gives a row
    for each, an unknown or null one none.
    """
    tasks = max(1, min(manifest.count(), READ_TASKS))
    index = manifest.repartition(tasks, "path").mapInArrow(_heads, "doc_id long, path string, place long")
    asked = wanted.select(F.col("doc_id").cast("long"), F.col("start").cast("long"), F.col("count").cast("long")).join(index, "doc_id")
    # a file that many ask for is read by up to eight tasks
    dealt = asked.repartition(tasks, "path", F.pmod(F.xxhash64("doc_id", "start"), F.lit(8))).sortWithinPartitions("path")
    return dealt.mapInArrow(_fetch, "doc_id long, start long, count long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and describe what is read back."""
    return read_ids(write_ids(docs, scratch(docs.sparkSession, "token-ids"), tokenizer))
