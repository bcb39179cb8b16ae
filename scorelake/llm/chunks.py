"""Token ids of texts by way of the parts between spaces.

The patterns of byte-level tokenizers attach a space to the part that follows it. A text may therefore be cut before
each single space that something other than white space follows: no match of the pattern reaches over such a cut.
Parts recur, so a worker keeps the ids of those it has seen lately in a few flat arrays, and only new parts are
encoded. All parts of a batch are hashed, looked up and put together again by array operations. A text with a space
before other white space, or before a character whose first byte may begin white space beyond ASCII, is not cut but
encoded whole; so is a part of more than LONGEST bytes, which is not kept either.

A part is looked up by a 64-bit hash and taken for known only if its bytes are the same, byte by byte; of parts that
share a hash, the later ones are encoded each time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from scorelake.llm.common import slices

#: A space before white space, before a byte that may begin white space beyond ASCII, or at the end.
_UNCUT = re.compile(rb" (?:[\s\x1c-\x1f\xc2\xe1\xe2\xe3]|\Z)")
AT_ONCE, LONGEST = 1 << 19, 64
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD1B54A32D192ED03)
_powers: list[np.ndarray] = []


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span, from prefix sums over the whole buffer."""
    if not _powers or len(_powers[0]) <= len(buf):
        _powers.clear()
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(AT_ONCE, len(buf)) + 1, factor, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x, dtype=np.uint64))
    up, down = _powers
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return (h ^ (h >> np.uint64(29))) * _MIX


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after the other."""
    upto = np.cumsum(lengths)
    return np.repeat(starts - (upto - lengths), lengths) + np.arange(int(upto[-1]) if len(upto) else 0)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _words(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as numbers."""
    return np.lib.stride_tricks.sliding_window_view(buf, 8)[at].view("<u8").ravel()


def _equal(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which spans of two buffers hold the same bytes: eight at a time up to LONGEST, longer spans byte by byte."""
    same = np.ones(len(lengths), bool)
    a, b = (np.concatenate([x, np.zeros(8, np.uint8)]) for x in (a, b))
    for k in range(0, LONGEST, 8):
        live = np.flatnonzero(same & (lengths > k) & (lengths <= LONGEST))
        if not len(live):
            break
        other = _words(a, at_a[live] + k) ^ _words(b, at_b[live] + k)
        same[live] = (other & _MASKS[np.minimum(lengths[live] - k, 8)]) == 0
    long = np.flatnonzero(lengths > LONGEST)
    if len(long):
        other = a[spread(at_a[long], lengths[long])] != b[spread(at_b[long], lengths[long])]
        same[long] = ~np.logical_or.reduceat(other, np.cumsum(lengths[long]) - lengths[long])
    return same


class ChunkEncoder:
    """encode(parts) gives each part's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int = 600_000, at_once: int | None = None):
        self._encode, self._bound, self._turn, self._seen = encode, remembered, 0, 0
        self._at_once = at_once or AT_ONCE
        self._forget()

    def _forget(self) -> None:
        #: By the hash: where a part's bytes are, how many, where its ids are, how many, and when it was last used.
        self._hash = np.zeros(0, np.uint64)
        self._text, self._len, self._at, self._n, self._used = (np.zeros(0, np.int64) for _ in range(5))
        self._bytes, self._pool = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    def __call__(self, found: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices([len(t) for t in found], self._at_once):
            out += self._some(found[a:b])
        return out

    def _some(self, found: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(found)
        whole = [i for i, t in enumerate(found) if len(t) > self._at_once or _UNCUT.search(t)]
        for i, x in zip(whole, self._encode([found[i].decode(errors="replace") for i in whole]), strict=True):
            out[i] = x
        apart = set(whole)
        cut = [i for i, t in enumerate(found) if t and i not in apart]
        if cut:
            for i, x in zip(cut, self._cut([found[i] for i in cut]), strict=True):
                out[i] = x
        return out

    def _cut(self, found: list[bytes]) -> list[bytes]:
        raw = b"".join(found)
        buf = np.frombuffer(raw, np.uint8)
        docs = np.cumsum([0, *map(len, found)])
        begins = buf == 32
        begins[docs[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buf))
        size = ends - starts
        first = _hashes(buf, starts, ends)
        keys, at, back = np.unique(first, return_index=True, return_inverse=True)
        # parts whose hash another part of the batch has
        alike = size[at][back] == size
        alike[alike] = _equal(buf, starts[alike], buf, starts[at][back][alike], size[alike])
        odd = np.flatnonzero(~alike)
        place = np.searchsorted(self._hash, keys)
        near = np.minimum(place, max(0, len(self._hash) - 1))
        same = self._hash[near] == keys if len(self._hash) else np.zeros(len(keys), bool)
        known = same & (self._len[near] == size[at]) if len(self._hash) else same
        known[known] = _equal(buf, starts[at][known], self._bytes, self._text[near[known]], size[at][known])
        self._turn += 1
        self._used[near[known]] = self._turn
        ask = np.concatenate([at[~known], odd])
        ids = self._encode([raw[a:b].decode(errors="replace") for a, b in zip(starts[ask].tolist(), ends[ask].tolist(), strict=True)])
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.concatenate([self._pool, np.frombuffer(b"".join(ids), "<u4")])
        begin = len(self._pool) + np.cumsum(n) - n
        fresh = len(keys) - int(known.sum())
        where, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        where[known], count[known] = self._at[near[known]], self._n[near[known]]
        where[~known], count[~known] = begin[:fresh], n[:fresh]
        where, count = where[back], count[back]
        where[odd], count[odd] = begin[fresh:], n[fresh:]
        upto = np.cumsum(count)
        tokens = pool[spread(where, count)].tobytes()
        last = np.searchsorted(starts, docs[1:], "left") - 1
        edges = [0, *(4 * upto[last]).tolist()]
        fits = ~same & (size[at] <= LONGEST)
        self._keep(keys[fits], buf, starts[at][fits], size[at][fits], begin[:fresh][fits[~known]], n[:fresh][fits[~known]], place[fits], pool)
        return [tokens[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _keep(self, keys, buf, starts, size, where, n, place, pool) -> None:
        """Put new parts among the known ones; if these are too many, drop what has not been used since the last time,
        or all if that is too little."""
        text = len(self._bytes) + np.cumsum(size) - size
        self._bytes = np.concatenate([self._bytes, buf[spread(starts, size)]])
        self._hash = np.insert(self._hash, place, keys)
        self._text, self._len = np.insert(self._text, place, text), np.insert(self._len, place, size)
        self._at, self._n = np.insert(self._at, place, where), np.insert(self._n, place, n)
        self._used = np.insert(self._used, place, self._turn)
        self._pool = pool
        if len(self._hash) > self._bound or len(pool) > 16 * self._bound:  # the pool also holds ids of parts that are not kept
            stay = self._used > self._seen
            self._seen = self._turn
            if 4 * stay.sum() > 3 * self._bound:
                self._forget()
                return
            self._hash, self._used = self._hash[stay], self._used[stay]
            at, self._n, text, self._len = self._at[stay], self._n[stay], self._text[stay], self._len[stay]
            self._pool, self._bytes = self._pool[spread(at, self._n)], self._bytes[spread(text, self._len)]
            self._at, self._text = np.cumsum(self._n) - self._n, np.cumsum(self._len) - self._len
