"""Near-duplicate classes by a chosen-path Jaccard join over shingles of five words, similarity 0.8 or more.

1. Each text becomes its set of 64-bit shingle hashes, a digest of that set, and 64 min-hashes. Texts with one
   digest are copies; the set, under a number of its own, stands for all of them from here on, so that ids may repeat
   with other texts.
2. Chosen path: a run's root picks one or two of the 64 positions and splits the sets by their values there, so that
   two sets share a child with the probability of their similarity. Nodes of more than LEAF sets are split again at
   positions that a hash of the node picks; smaller ones are leaves, and leaves with equal members are kept once. The
   mean number of children, 1.25, makes a link of similarity 0.8 survive with one expected copy; runs are repeated
   until the chance that it survives in none of them is below 1 - recall, for five splits and a share of equal
   min-hashes that is just the similarity. All runs share the same min-hashes and nodes may be split six times, so
   for recall 0.9999 a link of exactly 0.8 is lost here with a chance of 1.3e-4 after one split, 1.0e-3 after five and
   2.3e-3 after six (``loss``).
3. Leaves are compared pair by pair on the min-hashes, with a margin that alone loses a link with a chance of 1.3e-4; a leaf
   yields one link for each set that has any, to the first set of its part, not the pairs. A node that a split hardly shrinks is a dense group
   of near copies: its members are compared to its least member, and only those unlike that one to all others, in blocks.
4. Components of the candidate links are the groups in which all pairs are compared exactly on the shingle sets, in
   blocks of BLOCK sets, so that a component of any size is spread over tasks. Exact links give each set's number of
   links (copies counted) and, by components again, the classes. A link that no run found is still found here if
   other links join its ends.

The pairs compared in step 4 grow with the square of a component's different texts; copies add nothing.

Defined cases: a text of one to four words is one shingle; texts without words (and null ones) and rows without an id
stand alone: class_id is their own id, n_links 0; rows that repeat an id and its text are copies of each other, rows
that repeat an id with another text are other documents; an empty table gives no rows; other columns are left out. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import column, free_name, groups, scratch, ship, slices, texts
from scorelake.llm.components import components

WORDS, POSITIONS, LEAF, BLOCK = 5, 64, 2_048, 512
#: Splits below the root at most; a node that keeps this share of its parent is dense.
DEPTH, DENSE = 5, 0.7
#: Rows about sets that may be broadcast to fetch their texts again; beyond it the texts are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_random = np.random.default_rng(20_240_607)
_A = (_random.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _random.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of five words."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        out = _mix(out * _P + h[i : i + n] + np.uint64(i + 1))
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """The min-hashes of a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(x), 2048):
        out = np.minimum(out, (_A[:, None] * x[None, a : a + 2048] + _B[:, None]).min(1))
    return out


def runs_needed(similarity: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a link of ``similarity`` has survived ``depth`` splits in at least one with chance ``recall``.
    A node splits at one position, a quarter of them at two."""
    lost = 0.0
    for _ in range(depth):
        child = 1 - similarity + similarity * lost
        lost = 0.75 * child + 0.25 * child * child
    return math.ceil(math.log(1 - recall) / math.log(lost))


def loss(similarity: float, runs: int, splits: int) -> float:
    """The chance that a link of exactly ``similarity`` is no candidate after ``runs`` whose nodes are split ``splits``
    times, the root's split included: averaged over its number of equal min-hashes, which is the same in all runs, with
    the margin's part."""
    out = 0.0
    for equal in range(POSITIONS + 1):
        chance = math.comb(POSITIONS, equal) * similarity**equal * (1 - similarity) ** (POSITIONS - equal)
        share, lost = equal / POSITIONS, 0.0
        for _ in range(splits):
            child = 1 - share + share * lost
            lost = 0.75 * child + 0.25 * child * child
        out += chance * (lost**runs if equal >= math.ceil(margin(similarity) * POSITIONS) else 1)
    return out


def margin(similarity: float) -> float:
    """The share of equal min-hashes below which a pair is no candidate: four standard deviations off."""
    return similarity - 4 * math.sqrt(similarity * (1 - similarity) / POSITIONS)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, ids, marks = texts(batch), column(batch, "doc_id"), column(batch, "mark")
        for a, b in slices([len(t or b"") for t in found], 8 << 20):
            sets = [shingles(t) for t in found[a:b]]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    marks.slice(a, b - a),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "mark", "digest", "sketch"],
            )


def _sketches(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint32).reshape(-1, POSITIONS)


def _child(node: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(node * _P + position.astype(np.uint64)) + value.astype(np.uint64)).view(np.int64)


def _roots(runs: int):
    plan = np.random.default_rng(7)
    chosen = [(run, int(p)) for run in range(runs) for p in plan.choice(POSITIONS, 2 if run % 4 == 0 else 1, replace=False)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, rep = _sketches(column(batch, "sketch").to_pylist()), column(batch, "rep").to_numpy()
            keys = [_child(np.full(len(rep), run, np.uint64), np.full(len(rep), p), s[:, p]) for run, p in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(rep, len(chosen)))], ["key", "rep"])

    return split


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, rep = _sketches(column(batch, "sketch").to_pylist()), column(batch, "rep").to_numpy()
        node, size = column(batch, "key").to_numpy().view(np.uint64), column(batch, "n").to_numpy()
        draw = _mix(node + np.uint64(99))
        first = draw % np.uint64(POSITIONS)
        second = (first + np.uint64(1) + (draw >> np.uint64(20)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
        two = (draw >> np.uint64(50)) % np.uint64(4) == 0
        at = np.arange(len(rep))
        keys = np.concatenate([_child(node, first, s[at, first.astype(int)]), _child(node, second, s[at, second.astype(int)])[two]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([rep, rep[two]])), pa.array(np.concatenate([size, size[two]]))], ["key", "rep", "above"])


def _stars(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """For each of n sorted members the first member that ``pairs`` connect it with."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def _candidates(similarity: float):
    """In each group of sketches, links from each member to the first one that candidate links connect it with."""
    least = math.ceil(margin(similarity) * POSITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, g in groups(batches, "key"):
            reps = g["rep"]
            s = _sketches(g["sketch"])
            near = lambda i: (np.flatnonzero((s[i + 1 :] == s[i]).sum(1) >= least) + i + 1).tolist()
            for i, first in enumerate(_stars(len(reps), ((i, j) for i in range(len(reps) - 1) for j in near(i)))):
                if i != first:
                    a.append(reps[i])
                    b.append(reps[first])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _to_pivot(similarity: float):
    least = math.ceil(margin(similarity) * POSITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_sketches(column(batch, "sketch").to_pylist()) == _sketches(column(batch, "pivot_sketch").to_pylist())).sum(1) >= least
            names = ["key", "rep", "n", "pivot"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(near)], [*names, "near"])

    return run


def _dense_edges(dense: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate links of dense nodes (key, rep, n): all members against the least one, then those unlike it against
    the rest, each pair of blocks in a group of its own."""
    own = sets.select("rep", "sketch")
    pivots = dense.groupBy("key").agg(F.min("rep").alias("pivot")).join(own.withColumnRenamed("rep", "pivot").withColumnRenamed("sketch", "pivot_sketch"), "pivot")
    seen = scratch(dense.join(own, "rep").join(scratch(pivots, "pivots"), "key").mapInArrow(_to_pivot(similarity), "key bigint, rep bigint, n bigint, pivot bigint, near boolean"), "dense")
    direct = seen.where("near AND rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    unlike = seen.where(~F.col("near"))
    rest = scratch(unlike.groupBy("key").agg(F.count("*").alias("u")), "unlike")
    if rest.isEmpty():
        return direct
    some = seen.join(rest, "key")
    blocks, ublocks = F.ceil(F.col("n") / LEAF).cast("int"), F.ceil(F.col("u") / LEAF).cast("int")
    at = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "rep"), n.cast("bigint")).cast("int")
    members = some.select("key", "rep", at("block", blocks).alias("i"), F.explode(F.sequence(F.lit(0), ublocks - 1)).alias("j"))
    odd = some.where(~F.col("near")).select("key", "rep", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), at("ublock", ublocks).alias("j"))
    dealt = members.unionByName(odd).select(F.xxhash64("key", "i", "j").alias("key"), "rep").distinct()
    return direct.unionByName(_compared(dealt, sets, similarity))


def _compared(leaves: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate links inside each group (key, rep) of bounded size."""
    rows = leaves.join(sets.select("rep", "sketch"), "rep").select("key", "rep", "sketch")
    return rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_candidates(similarity), "a bigint, b bigint")


def candidate_edges(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Steps 2 and 3: spanning candidate links (a, b) between sets (rep, sketch)."""
    runs = runs_needed(similarity, recall)
    rows = scratch(sets.select("rep", "sketch").mapInArrow(_roots(runs), "key bigint, rep bigint"), "roots").withColumn("above", F.lit(None).cast("bigint"))
    leaves, edges = [], []
    for depth in range(DEPTH + 1):
        counts = scratch(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        alive = rows.join(counts, "key")
        members = alive.where(F.col("n") <= LEAF).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("members"))
        leaves.append(scratch(members.select("members").distinct(), "leaves"))
        big = scratch(alive.where(F.col("n") > LEAF), "large")
        if big.isEmpty():
            break
        stuck = F.lit(True) if depth == DEPTH else F.coalesce(F.col("n") > DENSE * F.col("above"), F.lit(False))
        dense = big.where(stuck).select("key", "rep", "n")
        if not dense.isEmpty():
            edges.append(scratch(_dense_edges(dense, sets, similarity).distinct(), "dense-edges"))
        more = big.where(~stuck)
        if depth == DEPTH or more.isEmpty():
            break
        rows = scratch(more.join(sets.select("rep", "sketch"), "rep").mapInArrow(_split, "key bigint, rep bigint, above bigint"), "children")
    all_leaves = leaves[0]
    for more in leaves[1:]:
        all_leaves = all_leaves.unionByName(more)
    small = all_leaves.distinct().select(F.xxhash64("members").alias("key"), F.explode("members").alias("rep"))
    edges.append(_compared(small, sets, similarity))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def _linked(sets: list[np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets have intersection / union >= similarity, exactly, as a boolean matrix."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    value, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = (count > 1)[where]
    owner, where = owner[keep], shared[where[keep]]
    common = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    width = 4096
    for a in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        lo, hi = np.searchsorted(where, [a, a + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], where[lo:hi] - a] = 1
        common += (part @ part.T).astype(np.int64)
    both = size[:, None] + size[None] - common
    return (common * similarity[1] >= both * similarity[0]) & ~np.eye(len(sets), dtype=bool)


def _verified(similarity: tuple[int, int]):
    """For each group: kind 0, links of a set; kind 1, a link to the first set of its part; kind 2, the class of a set,
    where the group is the whole component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for _, g in groups(batches, "key"):
            once = [k for k, r in enumerate(g["rep"]) if not k or r != g["rep"][k - 1]]  # rows that repeat an id and its text
            g = {n: [c[k] for k in once] for n, c in g.items()}
            reps, block = g["rep"], np.array(g["block"])
            linked = _linked([np.frombuffer(x, np.uint64) for x in g["shingles"]], similarity)
            first = _stars(len(reps), ((i, j) for i in range(len(reps)) for j in (np.flatnonzero(linked[i, i + 1 :]) + i + 1).tolist()))
            whole = g["blocks"][0] == 1
            out += [(2 if whole else 1, r, reps[k]) for r, k in zip(reps, first, strict=True) if whole or r != reps[k]]
            if g["i"][0] != g["j"][0]:
                linked &= block[:, None] != block[None]
            out += [(0, r, int(n)) for r, n in zip(reps, linked @ np.array(g["copies"], np.int64), strict=True) if n]
            if len(out) > 10_000:
                yield _triples(out)
                out = []
        yield _triples(out)

    return run


def _triples(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["kind", "a", "b"])


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of texts that have the digest they are looked for by, each set once in a partition."""
    names = ["rep", "root", "blocks", "copies"]
    seen: set[int] = set()
    for batch in batches:
        digests, reps = column(batch, "digest").to_pylist(), column(batch, "rep").to_pylist()
        keep, found = [], []
        for k, text in enumerate(texts(batch)):
            if reps[k] in seen:
                continue
            own = shingles(text).tobytes()
            if xxhash.xxh3_128_digest(own) == digests[k]:
                seen.add(reps[k])
                keep.append(k)
                found.append(own)
        yield pa.RecordBatch.from_arrays([*(column(batch, n).take(pa.array(keep, pa.int64())) for n in names), pa.array(found, pa.binary())], [*names, "shingles"])


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``mark``, a hash of the text that tells rows with one id apart."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("mark", F.xxhash64("text"))


def _classes(docs: DataFrame, similarity: tuple[int, int], recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, mark, digest, sketch), and for each digest its class: class_id, the class's first row (doc_id,
    mark) as ``first``, and n_links."""
    ship(docs.sparkSession)
    target = similarity[0] / similarity[1]
    rows = narrow(docs)
    described = scratch(rows.select("doc_id", "mark", "text").mapInArrow(_described, "doc_id bigint, mark bigint, digest binary, sketch binary"), "described")
    taking = described.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    grouped = taking.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    sets = scratch(grouped.withColumn("rep", F.monotonically_increasing_id()), "sets")  # numbers are fixed once written

    parts = scratch(components(candidate_edges(sets, target, recall)), "candidate-components")
    sizes = parts.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = parts.join(scratch(sizes, "sizes"), "root").join(sets.select(F.col("rep").alias("node"), "first", "copies", "digest"), "node")
    members = scratch(placed.select("first.doc_id", "first.mark", F.col("node").alias("rep"), "root", "blocks", "copies", "digest"), "members")
    few = members.count() <= BROADCAST_ROWS
    wanted = rows.join(F.broadcast(members) if few else members, ["doc_id", "mark"]).select("rep", "root", "blocks", "copies", "digest", "text")
    found = wanted.mapInArrow(_with_shingles, "rep bigint, root bigint, blocks int, copies bigint, shingles binary")
    block = F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks").cast("bigint")).cast("int")
    dealt = found.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.select(F.xxhash64("root", "i", "j").alias("key"), "i", "j", "block", "blocks", "rep", "copies", "shingles")
    results = scratch(dealt.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_verified(similarity), "kind int, a bigint, b bigint"), "links")

    links = results.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    labels = results.where("kind = 2").select(F.col("a").alias("rep"), F.col("b").alias("label"))
    across = results.where("kind = 1").select("a", "b")
    if not across.isEmpty():
        labels = labels.unionByName(components(across).select(F.col("node").alias("rep"), F.col("root").alias("label")))
    labels = labels.groupBy("rep").agg(F.min("label").alias("label"))
    labelled = sets.select("digest", "rep", "first", "copies").join(labels, "rep", "left").join(links, "rep", "left")
    labelled = scratch(
        labelled.select("digest", "first", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labelled"
    )
    firsts = labelled.groupBy("label").agg(F.min("first").alias("first"))
    classes = labelled.drop("first").join(firsts, "label").select("digest", F.col("first.doc_id").alias("class_id"), "first", "n_links")
    return described, scratch(classes, "classes")


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, n_links of every row: class_id is the least id of the documents that links connect with it,
    n_links the number of other rows whose similarity with it is at least similarity[0] / similarity[1]."""
    described, classes = _classes(docs, similarity, recall)
    taking = described.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    alone = described.where(F.col("doc_id").isNull() | F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return taking.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id", "n_links").unionByName(alone)


def without_near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.9999) -> DataFrame:
    """``docs`` with one row of each class, the one with the least id (then the least hash of its text); rows without an
    id or without words stay. Rows are told apart by id and text, so no text that is like no other is lost."""
    described, classes = _classes(docs, similarity, recall)
    rows = described.where(F.col("doc_id").isNotNull()).join(classes.select("digest", "first"), "digest")
    rows = rows.groupBy("doc_id", "mark", (F.struct("doc_id", "mark") == F.col("first")).alias("stays")).agg(F.count("*").alias("n"))
    told = scratch(rows.where("NOT stays OR n > 1"), "not-single")
    keys = [docs["doc_id"].cast("bigint").eqNullSafe(told["doc_id"]), F.xxhash64(docs["text"].cast("string")).eqNullSafe(told["mark"])]
    kept = docs.join(told, keys, "left_anti")
    again = told.where("stays")
    if again.isEmpty():
        return kept
    names = [free_name(docs, "_id"), free_name(docs, "_mark")]
    marked = docs.withColumn(names[0], F.col("doc_id").cast("bigint")).withColumn(names[1], F.xxhash64(F.col("text").cast("string")))
    repeated = marked.join(again.select("doc_id", "mark").toDF(*names), names, "left_semi")
    return kept.unionByName(repeated.dropDuplicates(names).select(*(F.col(f"`{n}`") for n in docs.columns)))
