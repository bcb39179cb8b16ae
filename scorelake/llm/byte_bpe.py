"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. Each adjacent pair whose bytes are in the vocabulary waits in the bucket of
its merge rank; a bitmap over the ranks, with a bitmap over its words, gives the lowest waiting rank by two
find-first-set steps. The leftmost position of that bucket is merged, its two new neighbours are queued, and entries
whose pair has changed meanwhile are skipped when they come up. A pre-token of n bytes costs O(n log n) at worst (the
heap inside a bucket keeps positions in order), however long it is.

Ids are the ranks. Defined cases: a null text is an empty one (no ids); ranks that lack a pre-token's single bytes
raise KeyError; repeated rows and null ids are kept as rows; an empty table gives an empty result; other columns are
left out. Bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.chunks import ChunkEncoder, spread
from scorelake.llm.common import Recent, append_columns, column, ship, texts

#: A bitmap word has 256 bits.
BITS, MASK = 8, 255
MERGES_KEPT = 500_000
#: Pre-tokens whose ids a worker remembers unless told otherwise, and their greatest length; parts are remembered twice
#: as many.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 40


class RankQueue:
    """Positions in buckets by rank, with a bitmap of the waiting ranks (``words``) and one of its non-zero words (``top``,
    empty between merges). RankBPE.merge puts positions in and takes the lowest rank's leftmost one out, in line, since a
    call for each step would cost more than the step."""

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> BITS) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}


class RankBPE:
    """Encodes and decodes by a vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = [ranks.get(bytes([i])) for i in range(256)]
        self.findall = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.merges: dict[int, int] = {}
        self.known = Recent(remembered)
        #: The rank of each two bytes, -1 if there is none.
        self.pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        width = [len(self.bytes_of.get(r, b"")) for r in range(max(ranks.values()) + 1)]
        self.token_width = np.array(width)
        self.token_start = np.cumsum(self.token_width) - self.token_width
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(r, b"") for r in range(len(width))), np.uint8)

    def _rank(self, left: int, right: int) -> int:
        """The rank of two tokens' joined bytes, -1 if there is none."""
        key = left << 32 | right
        rank = self.merges.get(key)
        if rank is None:
            if len(self.merges) >= MERGES_KEPT:
                self.merges.clear()
            rank = self.merges[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        if None in ids:
            raise KeyError("the vocabulary lacks a single byte")
        n, queue, merges, rank_of, pairs = len(ids), self.queue, self.merges, self._rank, self.pairs
        words, buckets, top = queue.words, queue.buckets, queue.top
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        waits.append(-1)
        for p, rank in enumerate(waits):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(p)  # positions rise, so a bucket stays in heap order
                else:
                    buckets[rank] = [p]
                    word = rank >> BITS
                    words[word] |= 1 << (rank & MASK)
                    top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1  # find-first-set over the words, then in the word
            bits = words[word]
            bit = bits & -bits
            rank = (word << BITS) + bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                p = heappop(bucket)
            else:  # the bucket is taken out
                p = bucket[0]
                del buckets[rank]
                words[word] = bits ^ bit
                if bits == bit:
                    top ^= 1 << word
            if waits[p] != rank:
                continue  # stale
            gone = after[p]
            ids[p], waits[gone] = rank, -1
            after[p] = following = after[gone]
            waits[p] = -1
            if following < n:
                before[following] = p
                right = ids[following]
                new = merges.get(rank << 32 | right)
                if new is None:
                    new = rank_of(rank, right)
                if new >= 0:
                    waits[p] = new
                    if new in buckets:
                        heappush(buckets[new], p)
                    else:
                        buckets[new] = [p]
                        word = new >> BITS
                        words[word] |= 1 << (new & MASK)
                        top |= 1 << word
            previous = before[p]
            if previous >= 0:
                left = ids[previous]
                new = merges.get(left << 32 | rank)
                if new is None:
                    new = rank_of(left, rank)
                waits[previous] = new
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], previous)
                    else:
                        buckets[new] = [previous]
                        word = new >> BITS
                        words[word] |= 1 << (new & MASK)
                        top |= 1 << word
        out, p = [], 0
        while p < n:
            out.append(ids[p])
            p = after[p]
        return out

    def encode_parts(self, parts: list[str], letters: bool = True) -> list[bytes]:
        """Each part's ids as little-endian unsigned 32-bit integers; a part is cut by the pattern first. Short
        pre-tokens recur in parts that differ in punctuation only, so their ids are remembered. ``letters``: the pattern
        takes a space and letters only for one match."""
        self.known.turn()
        young, old, findall, merge = self.known.young, self.known.old, self.findall, self.merge
        out = []
        for part in parts:
            ids = []
            for piece in (part,) if letters and part[:1] == " " and part[1:].isalpha() else findall(part):
                got = young.get(piece)
                if got is None:
                    got = old.get(piece)
                    if got is None:
                        got = array("I", merge(piece.encode())).tobytes()
                    if len(piece) <= REMEMBERED_LENGTH:
                        young[piece] = got
                ids.append(got)
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4")
        return self.token_bytes[spread(self.token_start[tokens], self.token_width[tokens])].tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_workers: dict[tuple, tuple[RankBPE, Callable[[list[bytes]], list[bytes]]]] = {}


def coder(path: str, pattern: str, remembered: int = REMEMBERED) -> tuple[RankBPE, Callable[[list[bytes]], list[bytes]]]:
    """This worker's encoder of a rank file, loaded once. Texts are cut into parts only for the pattern that allows it."""
    key = (path, pattern, remembered)
    if key not in _workers:
        bpe = RankBPE(load_ranks(path), pattern, remembered)
        if pattern == public_tokenizers.PATTERN:
            _workers[key] = bpe, ChunkEncoder(bpe.encode_parts, 2 * remembered)
        else:
            _workers[key] = bpe, lambda found: bpe.encode_parts([t.decode(errors="replace") for t in found], letters=False)
    return _workers[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with ``ids``: the text's ids as binary, little-endian unsigned 32-bit integers. A map, no shuffle. With
    ``decoded``, a column of that name has the SHA-256 of what the ids decode to, and ValueError is raised where that
    is not the text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe, encoder = coder(path, pattern, remembered)
        given = [t or b"" for t in texts(batch, text)]
        found = encoder(given)
        out = [pa.array(found, pa.binary())]
        if decoded:
            back = [bpe.decode(x) for x in found]
            for t, x in zip(given, back, strict=True):
                if x != t and x != t.decode(errors="replace").encode():
                    raise ValueError("ids do not decode to their text")
            out.append(pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()))
        return out

    return append_columns(docs, run, [(ids, "binary"), *([(decoded, "string")] if decoded else [])])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of each whole text's ids and of what they decode to."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = coder(path, pattern)
        for batch in batches:
            ids = encoder([t or b"" for t in texts(batch)])
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return narrow.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
