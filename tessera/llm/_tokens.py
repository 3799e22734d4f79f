"""Token ids of many texts with the tokenizers library, one encode per distinct piece.

A text is cut where the pre-tokenizer is certain to cut it too, whatever
stands around: before a lone space (or, byte-level, a lone line feed) between
two characters that are no white space.  No byte-level token crosses such a
place, and a vocabulary that drops white space sees words there, so the ids
of the pieces in a row are the ids of the whole text.  Arrow finds the
distinct pieces of a slice of texts, and each goes to the library once per
worker: a piece of letters alone straight to its BPE model, since the
pre-tokenizer keeps such a piece whole, any other through all of its steps.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm import _held

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Taken off a word's end when the rest ends in a letter: letters and these never share a token.
_TAIL = ".,*$%&#!?;:"
#: Distinct pieces held by one worker before it starts afresh; results do not depend on it.
MAX_PIECES = 450_000
#: Characters of text in work at a time.
SLICE_CHARS = 2_000_000

_WIDE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space to Python's str.split, but ordinary characters to the tokenizers.
_ODD = r"\x{1c}-\x{1f}"
_ALL = rf"\s\x{{0b}}{_ODD}{_WIDE}"
#: Texts that must not be cut at every space: a space or line feed that is not alone.
_UNEVEN = rf"(?s)<\||\x{{00}}|[{_ALL}][ \n]|[ \n][{_ALL}]|\A[ \n]|[ \n]\z"
#: Texts with white space that Arrow's ASCII split does not know.
_OTHER = rf"<\||\x{{00}}|[{_ODD}{_WIDE}]"
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: A line feed before a word, which is a token of its own.
_FED = rf"\A\n[^{_ALL}]"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in byte-level vocabularies.
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}

_open: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a vocabulary file."""
    _held.take("tokens", _open.clear)
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


class _Codes(dict):
    """Piece -> code; new pieces get the next code and are noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.new.append(piece)
        return code


class Encoder:
    """Whole texts to ids, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.byte_level = self.library.normalizer is None
        self._fresh()

    def _fresh(self) -> None:
        self.codes = _Codes()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    # Keys of pieces.  Byte-level: "\0x" stands at a text's start or behind another part, "\nx" after
    # a line feed, "x" after a space.  Otherwise a key is the word.

    def _keys(self, text: str) -> list[str] | None:
        """The keys of a text that is not cut at every space; None where it must be encoded whole."""
        if "<|" in text or "\0" in text:
            return None
        if not self.byte_level:
            return None if _NOT_SPACE.search(text) else text.split()
        if not text or text.isspace():
            return None
        pieces = _LONE_SPACE.split(text)
        pieces[0] = "\0" + pieces[0]
        return pieces

    def _ids(self, key: str) -> list[int]:
        """Ids of a key: of letters alone from the model, of others by all steps of the library."""
        if key in ("", "\0"):
            return []
        bare, lead = (key[1:], "") if key[0] == "\0" else (key, "Ġ" if self.byte_level else "")
        if bare.isalpha():
            low = bare
            if not self.byte_level:
                low = bare.lower() if bare.isascii() else self.library.normalizer.normalize_str(bare)
            if low.isascii():
                return [t.id for t in self.model.tokenize(lead + low)]
            if low.isalpha():
                return [t.id for t in self.model.tokenize(lead + low.encode().decode("latin-1").translate(_BYTES))]
        text = key if not self.byte_level else bare if not lead else " " + key
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self) -> None:
        """Encode the new keys."""
        until, ids = [], array("I")
        # a list a key would be held until the end, and the garbage collector would walk them all again and again
        for key in self.codes.new:
            ids.extend(self._ids(key))
            until.append(len(ids))
        n = np.diff(np.array(until, np.int64), prepend=0)
        end = len(self.codes)
        self._room(end)
        # new codes are the last ones, in order
        self.start[end - len(n) : end] = self._store(np.array(ids, np.uint32)) + np.cumsum(n) - n
        self.size[end - len(n) : end] = n
        self.codes.new.clear()

    def _parts(self, pieces: pa.Array) -> np.ndarray:
        """Codes of each piece's parts, one row a piece: a line feed before it, the piece without its tail, the tail."""
        none = self.codes["\0" if self.byte_level else ""]
        lead = np.full(len(pieces), none, np.int64)
        tail = np.full(len(pieces), none, np.int64)
        base = pc.utf8_rtrim(pieces, _TAIL)
        cut = (pc.binary_length(pieces).to_numpy() - pc.binary_length(base).to_numpy()).astype(np.int64)
        last = pc.utf8_slice_codeunits(base, -1).dictionary_encode()
        letter = np.array([c.isalpha() for c in last.dictionary.to_pylist()], bool)
        tailed = (cut > 0) & letter[last.indices.to_numpy()]
        for size in np.unique(cut[tailed]).tolist():
            own = np.flatnonzero(tailed & (cut == size))
            ends = pc.utf8_slice_codeunits(pieces.take(pa.array(own)), -size).dictionary_encode()
            names = ["\0" + t if self.byte_level else t for t in ends.dictionary.to_pylist()]
            tail[own] = np.array([self.codes[t] for t in names], np.int64)[ends.indices.to_numpy()]
        body = pc.if_else(pa.array(tailed), base, pieces)
        if self.byte_level:
            fed = pc.match_substring_regex(body, _FED)
            if pc.any(fed).as_py():
                body = pc.replace_substring_regex(body, r"\A\n", "\0")
                lead[fed.to_numpy(zero_copy_only=False)] = self.codes["\0\n"]
        named = body.dictionary_encode()
        # through numpy, as to_pylist makes an Arrow scalar of every piece first
        bodies = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.codes.__getitem__, bodies), np.int64, len(bodies))
        return np.stack([lead, known[named.indices.to_numpy()], tail], 1)

    def _room(self, n: int) -> None:
        if n > len(self.start):
            grow = max(n, 2 * len(self.start))
            self.start = np.concatenate([self.start, np.zeros(grow - len(self.start), np.int64)])
            self.size = np.concatenate([self.size, np.zeros(grow - len(self.size), np.int64)])

    def _store(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.flat):
            grow = max(self.used + len(ids), 2 * len(self.flat))
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(grow - self.used, np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces of all texts, in order, pieces per text)."""
        if self.byte_level:
            marked = pc.binary_join_element_wise(pa.scalar("\0"), pc.replace_substring(texts, "\n", " \n"), pa.scalar(""))
            cut = pc.split_pattern(marked, " ")
        else:
            cut = pc.ascii_split_whitespace(texts)
        return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)

    def _slice(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        odd = pc.match_substring_regex(texts, _UNEVEN if self.byte_level else _OTHER).to_numpy(zero_copy_only=False)
        pieces, counts = self._cut(texts.filter(pa.array(~odd)) if odd.any() else texts)
        each, more, alone = counts, [], {}
        if odd.any():
            each = np.zeros(len(texts), np.int64)
            each[~odd] = counts
            for k in np.flatnonzero(odd).tolist():
                keys = self._keys(texts[k].as_py())
                if keys is None:
                    alone[k] = self.whole(texts[k].as_py())
                    keys = []
                more += keys
                each[k] = len(keys)
            pieces = pa.concat_arrays([pieces, pa.array(more, pa.string())])
        named = pieces.dictionary_encode()
        parts = self._parts(named.dictionary)
        if self.codes.new:
            self._learn()
        own = self.size[parts].sum(1)
        at = named.indices.to_numpy(zero_copy_only=False)
        if odd.any():
            # pieces stand as (plain texts, others): bring them into the order of texts
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            first = np.zeros(len(texts), np.int64)
            first[order] = np.cumsum(each[order]) - each[order]
            at = at[spread(first, each)]
        n = np.bincount(np.repeat(np.arange(len(texts)), each), weights=own[at], minlength=len(texts)).astype(np.int64)
        flat = None
        if want_ids:
            table = self.flat[spread(self.start[parts].ravel(), self.size[parts].ravel())]
            flat = table[spread((np.cumsum(own) - own)[at], own[at])]
            if alone:
                split = np.split(flat, np.cumsum(n)[:-1])
                flat = np.concatenate([alone.get(k, split[k]) for k in range(len(texts))])
        for k, ids in alone.items():
            n[k] = len(ids)
        if len(self.codes) > MAX_PIECES:
            self._fresh()
        return flat, n

    def batches(self, texts: pa.Array | list[str], want_ids: bool = True) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray]]:
        """(first, end, ids one text after the other, ids per text) for slices of bounded size; texts are not null."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_CHARS, "right")))
            yield at, end, *self._slice(texts.slice(at, end - at), want_ids)
            at = end


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + size`` of every run, one run after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)
