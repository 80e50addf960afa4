"""Whole texts to token ids with a public tokenizer file, exactly as the library encodes them.

A text is cut where the tokenizer never merges: at ASCII white space. The units of a block of texts are
found and told apart by array operations; each distinct unit is encoded once by the library and kept, so
that a text is a sequence of look-ups. What is kept is bounded: when it is full, units that came once go, those met most
stay. A text in which a cut could matter (other white space next to it,
or the string of a special token) goes to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa

#: the white space that separates units, by byte
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: white space beyond ASCII, and the controls that only some engines count as such
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")
#: what every match of _ODD holds, found faster
_HINTS = (b"<|", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2", b"\xe1\x9a", b"\xe2", b"\xe3\x80")
#: letters (ASCII, or U+00C0 to U+00FF but for the two signs), then marks
_TAILED = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?|]*)")
MARK = b"<|endoftext|>"
#: Units that a worker keeps, about 200 bytes each.
KEPT = 600_000


def _printable() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    fine = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in fine]
    return {b: chr(b) for b in fine} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _printable()


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def units(texts: list[bytes], byte_level: bool) -> tuple[pa.Array, np.ndarray]:
    """(all units one after the other, number of units of each text).

    Words are runs without white space. Where white space counts (``byte_level``) a space belongs to the word after it, and of
    a longer run of white space the last character stands by itself.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    space, n = _SPACE[data], len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    begin = edge[:n].copy()
    if byte_level:
        begin[1:] |= space[1:] & ~space[:-1]
        begin[:-1] |= space[:-1] & ~space[1:] & ~edge[1:n]
        begin[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
        starts = np.flatnonzero(begin)
        offsets = np.append(starts, n)
    else:
        begin[1:] |= space[:-1]
        begin &= ~space
        starts = np.flatnonzero(begin)
        offsets = np.append((np.cumsum(~space) - 1)[starts], n - np.count_nonzero(space))
        data = data[~space]
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return parts, np.diff(np.searchsorted(starts, bounds))


class Encoder:
    """``byte_level``: white space is kept in tokens (else it only separates them). ``kept``: units held from call to call."""

    def __init__(self, path: str, byte_level: bool, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.byte_level, self.kept = Tokenizer.from_file(path), byte_level, kept
        self.mark = self.tokenizer.token_to_id(MARK.decode())
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.starts = self.sizes = np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int32)

    def thin(self) -> None:
        """Of the units met in two calls or more since the last time those met most stay, at most half of ``kept``."""
        most = np.argsort(-self.met, kind="stable")[: self.kept // 2]
        stays = np.zeros(len(self.met), dtype=bool)
        stays[most] = self.met[most] > 1
        left = {u: k for u, k in self.index.items() if stays[k]}
        at = np.fromiter(left.values(), dtype=np.int64, count=len(left))
        sizes = self.sizes[at]
        flat = gather(self.flat, self.starts[at], sizes)
        self.forget()
        self._keep(list(left), flat, sizes)

    def _library(self, text: bytes) -> np.ndarray:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return np.array(encode([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _keep(self, units: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(units, range(len(self.sizes), len(self.sizes) + len(units)), strict=True))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.ones(len(sizes), dtype=np.int32)])
        self.used += len(flat)

    def _model(self, letters: list[bytes]) -> list[list[int]]:
        """Ids of units that the tokenizer does not cut any further, by its model alone."""
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(u.decode("latin-1").translate(_LETTERS))] for u in letters]

    def _learn(self, units: list[bytes]) -> None:
        """Encodes new units. One of letters and a tail of marks is two, as no token spans both; letters, in lower case where
        case does not count, are one piece for the model. The others go many in one call: a special token between them, which
        no unit holds, cuts the text.
        """
        letters, others, pairs, heads, tails = set(), set(), [], [], []
        for u in units:
            if m := _TAILED.fullmatch(u):
                head = m[1] if self.byte_level else m[1].lower() if m[1].isascii() else m[1].decode().lower().encode()
                letters.add(head)
                if head != u:
                    pairs.append(u)
                    heads.append(head)
                    tails.append(m[2])
            else:
                others.add(u)
        others.update(tails)
        others.discard(b"")
        new = [u for u in letters if u not in self.index]
        if new:
            ids = self._model(new)
            self._keep(new, np.array([x for own in ids for x in own], dtype=np.int32), np.array([len(own) for own in ids]))
        new = [u for u in others if u not in self.index]
        for lo in range(0, len(new), 1 << 12):
            part = new[lo : lo + (1 << 12)]
            ids = self._library(MARK.join([*part, b""]))
            ends = np.flatnonzero(ids == self.mark)
            self._keep(part, ids[ids != self.mark], np.diff(ends, prepend=-1) - 1)
        if pairs:
            if b"" not in self.index:
                self._keep([b""], np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64))
            both = np.fromiter((self.index[x] for p in zip(heads, tails, strict=True) for x in p), dtype=np.int64, count=2 * len(pairs))
            sizes = self.sizes[both]
            self._keep(pairs, gather(self.flat, self.starts[both], sizes), sizes.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, number of ids of each text)."""
        if len(self.index) > self.kept:
            self.thin()
        whole = {i: self._library(t) for i, t in enumerate(texts) if any(m in t for m in _HINTS) and _ODD.search(t)}
        parts, counts = units([b"" if i in whole else t for i, t in enumerate(texts)] if whole else texts, self.byte_level)
        told = parts.dictionary_encode()
        _, bounds, data = told.dictionary.buffers()
        bounds, raw = np.frombuffer(bounds, np.int32, len(told.dictionary) + 1).tolist() if len(parts) else [0], data.to_pybytes() if data else b""
        distinct = [raw[a:b] for a, b in pairwise(bounds)]
        found = np.fromiter(map(self.index.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        self.met[found[found >= 0]] += 1
        if len(late := np.flatnonzero(found < 0)):
            new = [distinct[k] for k in late.tolist()]
            self._learn(new)
            found[late] = np.fromiter(map(self.index.__getitem__, new), dtype=np.int64, count=len(new))
        at = found[told.indices.to_numpy()]
        sizes = self.sizes[at] if len(at) else at
        ids = gather(self.flat, self.starts[at] if len(at) else at, sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(edges)
        if whole:
            each = [whole[i] if i in whole else ids[edges[i] : edges[i + 1]] for i in range(len(texts))]
            ids, lengths = np.concatenate(each), np.array([len(p) for p in each])
        return ids, lengths


@lru_cache(maxsize=2)
def encoder(path: str, byte_level: bool, kept: int = KEPT) -> Encoder:
    """One for each Python worker, which keeps it from task to task."""
    return Encoder(path, byte_level, kept)
