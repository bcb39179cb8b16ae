"""Phrase collocation mining: phrases of a few words that are frequent and whose parts are rarely met apart.

Every shard (a bounded stretch of a task's texts of one language) gets a generalised suffix automaton over words, of
bounded depth. Nothing asks it to accept strings, so it is kept without transitions: its states, their endpos counts and
its suffix links are what sorting the reversed contexts of all positions gives, since the links form the tree of the
reversed pieces. A state stands for the suffixes of its longest phrase down to its shortest one, all with one count; the
shard enumerates these and Spark sums them by language and phrase.

There are two rounds. The first has depth 2 and counts words and pairs; the second cuts pieces between pairs that are
not frequent, which no frequent phrase contains, and counts longer phrases at full depth. The frequent pairs reach the
shards as a filter of a fixed number of bits. It errs only towards keeping pairs, and a phrase's occurrences are all
treated alike, so counts are exact at any fill.

A phrase is subsumed by one that is a word longer iff it is that one's suffix link or its prefix, and counts fall with
length, so a phrase inside any longer frequent one need only be compared with the phrases one word longer.

Defined results: a null or empty text has no words; a null language counts as ``und``; repeated rows count each time;
bytes that are no UTF-8 count as U+FFFD; ties rank by count, then by phrase in UTF-8 byte order; an empty table gives no
rows; other columns are not read. A text of any length is worked off in bounded stretches that overlap by the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.llm.common import drop, scratch, ship, texts

#: Bytes of text of one language in a shard, and rows of a batch that leaves it.
SHARD_BYTES = 4 << 20
OUT_ROWS = 50_000
#: Bits of the filter of frequent pairs: 16 MB, whatever the input holds.
FILTER_BITS = 1 << 27

#: Ends a piece. No UTF-8 text holds this byte.
STOP = b"\xff"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + STOP * 10)


def tokens(text: bytes) -> list[bytes]:
    """Words in order, and STOP wherever a piece ends."""
    return text.translate(_LOWER).replace(STOP, b" " + STOP + b" ").split()


def stretches(text: bytes, most: int) -> Iterator[bytes]:
    """``text`` in stretches of about ``most`` bytes that end before white space; a longer word stays whole."""
    start = 0
    while start < len(text):
        end = min((p for p in (text.find(c, start + most) for c in (b" ", b"\t", b"\n")) if p >= 0), default=len(text)) if start + most < len(text) else len(text)
        yield text[start:end]
        start = end


class Automaton:
    """States of the generalised suffix automaton of ``ids`` (0 ends a piece) up to ``depth`` words: ``end`` (a position
    where the state's phrases end), ``count`` (of all such positions), ``longest`` and ``shortest`` (lengths in words).
    The suffix link of a state leads to the one of its longest phrase's suffix of shortest - 1 words. ``joined`` says
    which positions follow the one before in a piece. The first ``skip`` positions are context only, and positions with
    fewer than ``least`` words behind them are left out."""

    def __init__(self, ids: np.ndarray, depth: int, joined: np.ndarray | None = None, skip: int = 0, least: int = 1):
        self.ids = ids
        if joined is None:
            joined = np.ones(len(ids), bool)
        contexts, alive = [ids], ids != 0
        for k in range(1, depth):
            back = np.zeros_like(ids)
            alive = alive & (np.arange(len(ids)) >= k)
            alive[k:] &= joined[1 : len(ids) - k + 1] & (ids[:-k] != 0)
            back[k:] = np.where(alive[k:], ids[:-k], 0)
            contexts.append(back)
        at = np.flatnonzero(contexts[least - 1])
        at = at[at >= skip]
        contexts = [c[at] for c in contexts]
        packed = [contexts[k].astype(np.uint64) << np.uint64(32) | (contexts[k + 1].astype(np.uint64) if k + 1 < depth else np.uint64(0)) for k in range(0, depth, 2)]
        order = np.argsort(packed[0], kind="stable") if len(packed) == 1 else np.lexsort(packed[::-1])
        contexts, at = [c[order] for c in contexts], at[order]
        found, size, new = [], np.zeros(0, np.int64), np.zeros(len(at), bool)
        new[:1] = True
        group = shortest = None
        for d, context in enumerate(contexts, 1):
            new[1:] |= context[1:] != context[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(at)))
            whole = context[starts] != 0
            short = np.full(len(starts), d)
            if d > 1:
                parent = group[starts]
                same = whole & (sizes == size[parent])
                short[same] = shortest[parent[same]]
                last["top"][parent[same]] = False
            last = {"end": at[starts], "count": sizes, "shortest": short, "top": whole.copy(), "longest": d}
            found.append(last)
            group, size, shortest = np.cumsum(new) - 1, sizes, short
        self.end, self.count, self.shortest, self.longest = (
            np.concatenate([f[k][f["top"]] if k != "longest" else np.full(f["top"].sum(), f[k]) for f in found]) for k in ("end", "count", "shortest", "longest")
        )

    def phrases(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, end positions and counts of all phrases of at least ``least`` words, state by state."""
        for length in range(least, int(self.longest.max(initial=0)) + 1):
            of = (self.shortest <= length) & (length <= self.longest)
            yield length, self.end[of], self.count[of]


def _pair_hashes(lang: str, words: list[bytes]) -> tuple[np.ndarray, int]:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), xxhash.xxh64_intdigest(lang.encode(), 1)


def _bits(first: np.ndarray, second: np.ndarray, lang: int, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each pair in the filter."""
    x = (first * np.uint64(0x9E3779B97F4A7C15) + second) ^ np.uint64(lang)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    mask = np.uint64(n_bits - 1)
    return x & mask, (x >> np.uint64(32)) & mask


def _joined(lang: str, names: list[bytes], ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which positions follow the one before as a pair that the filter has."""
    words, seed = _pair_hashes(lang, names)
    words = np.append(np.zeros(1, np.uint64), words)[ids]
    found = np.ones(len(ids), bool)
    for bits in _bits(words[:-1], words[1:], seed, len(table) * 64):
        found[1:] &= (table[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _rows(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrases.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, lengths: tuple[int, int], pairs: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, n: occurrences of all phrases of lengths[0] to lengths[1] words, as every shard counts them. With
    ``pairs``, a filter of frequent pairs, pieces are cut between others. Lengths from 1 on come with the empty phrase,
    the root of the automaton, which occurs as often as there are words."""
    spark = docs.sparkSession
    ship(spark)
    known = None if pairs is None else spark.sparkContext.broadcast(pairs)
    least, depth = lengths
    shard = SHARD_BYTES
    schema = "lang string, phrase string, n bigint"

    def count(lang: str, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for stretch in stretches(b"\n".join(parts), shard):
            line = held + tokens(stretch)
            names = list(dict.fromkeys(line))
            number = {w: k for k, w in enumerate(names, 1)}
            number[STOP] = 0
            ids = np.fromiter(map(number.__getitem__, line), np.int32, len(line))
            skip = len(held)
            held = line[-(depth - 1) :] if depth > 1 else []
            del line, number
            automaton = Automaton(ids, depth, None if known is None else _joined(lang, names, ids, known.value), skip, least)
            values = pa.array([b"", *names], pa.binary())
            total = np.count_nonzero(ids[skip:])
            if least == 1 and total:
                yield _rows(lang, values[:1], np.array([total]))
            for length, end, n in automaton.phrases(least):
                for start in range(0, len(n), OUT_ROWS):
                    last = end[start : start + OUT_ROWS]
                    columns = [values.take(pa.array(ids[last - k])) for k in range(length - 1, -1, -1)]
                    yield _rows(lang, columns[0] if length == 1 else pc.binary_join_element_wise(*columns, b" "), n[start : start + OUT_ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), texts(batch), strict=True):
                if text:
                    held.setdefault(lang.decode("utf-8", "replace"), []).append(text if text.isascii() else text.decode("utf-8", "replace").encode())
                    size += len(text)
                if size >= shard:
                    for name, parts in held.items():
                        yield from count(name, parts)
                    held, size = {}, 0
        for name, parts in held.items():
            yield from count(name, parts)
        pa.default_memory_pool().release_unused()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)


def _reduced(counts: DataFrame, least: int) -> DataFrame:
    """The sums of the shards' counts; of phrases only the frequent ones. The empty phrase stays."""
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def pair_filter(pairs: DataFrame, n_bits: int) -> np.ndarray:
    """The bits of all pairs, put together by an aggregation; at most n_bits / 64 rows come to the driver."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                rows.setdefault(lang, []).append(phrase.split(b" "))
            for lang, found in rows.items():
                first, seed = _pair_hashes(lang, [p[0] for p in found])
                second, _ = _pair_hashes(lang, [p[1] for p in found])
                bits = np.concatenate(_bits(first, second, seed, n_bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((bits & 63).astype(np.int32))], ["slot", "bit"])

    rows = pairs.select("lang", "phrase").mapInArrow(run, "slot bigint, bit int").groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out = np.zeros(n_bits // 64, np.uint64)
    found = rows.toArrow()
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _words(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def _without(of: Column, last: bool) -> Column:
    """A phrase without its last word, or without its first: its suffix link."""
    return F.concat_ws(" ", F.slice(of, 1, F.size(of) - 1) if last else F.slice(of, 2, F.size(of) - 1))


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, n_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, n: every phrase of up to ``longest`` words with at least ``least`` occurrences, and the empty phrase
    with the number of all words. A written table."""
    short = scratch(_reduced(phrase_counts(docs, (1, 2)), least), "phrases")
    if longest < 3:
        return short
    pairs = pair_filter(short.where(F.instr("phrase", " ") > 0), n_bits)
    return scratch(short.unionByName(_reduced(phrase_counts(docs, (3, longest), pairs), least)), "all-phrases")


def subsumed(candidates: DataFrame, share: tuple[int, int]) -> DataFrame:
    """lang, phrase of the candidates inside a longer one that has at least share[0]/share[1] of their occurrences."""
    longer = candidates.where(F.size(_words()) > 2)
    inside = longer.select("lang", "n", F.explode(F.array(_without(_words(), True), _without(_words(), False))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    wide = [F.col(c).cast("decimal(19,0)") for c in ("within", "n")]
    return candidates.join(most, ["lang", "phrase"]).where(wide[0] * share[1] >= wide[1] * share[0]).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, scale: int = 2_000_000, share: tuple[int, int] = (80, 100), top: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of every language the first ``top`` phrases of 2 to ``longest`` words."""
    counts = frequent_phrases(docs, longest, least)
    candidates = counts.where(F.instr("phrase", " ") > 0)
    kept = candidates.join(subsumed(candidates, share), ["lang", "phrase"], "left_anti")
    words = _words()
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("words", 1, F.col("k"))).alias("first"), F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"))
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast({scale} as decimal(9,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = parts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.score", "b.a", "b.l", "b.r")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where(F.col("phrase") == "").select("lang", "n")
    return first.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
