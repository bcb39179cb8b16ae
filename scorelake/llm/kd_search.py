"""Exact top-k by integer inner product, with a KD-tree per shard.

Vectors are scaled and floored to integers. Shards of about 8,192 vectors each get a KD-tree: median splits along the
widest dimension, a tight bounding box at every node. No vector of a box can score above
sum(max(q_i * low_i, q_i * high_i)) with a query q, so the trees are walked best first by that bound, for a block of
queries at a time: the node with the best bound of any query comes next, and it is looked at only by queries whose
current k-th result it could still beat (or tie with a smaller id).

A task holds one block of queries and the trees of up to 16 shards, all in one priority queue. With more shards, the
first 16 are searched first and each query's k-th score goes along to the tasks of the others; the partial results, k
per query and task, meet in a window by query. Nothing grows with the table but the number of shards and of tasks.

Defined cases: null vectors and those with a null or non-finite component take no part; a scaled component beyond 2**62
or a score beyond a long raises OverflowError, nothing is clipped; a shorter vector counts as filled up with zeros; rows
that repeat an id and its vector are candidates of their own, but ask once; no row with the query's own id is its
candidate; a query with fewer than k candidates gets all of them; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.llm.common import column, scratch, ship

#: Queries of a block: BLOCK, or fewer as long as there are fewer blocks than the cluster has cores.
SHARD, LEAF, BLOCK, LEAST_BLOCK, SHARDS_PER_TASK = 8_192, 128, 2_048, 256, 16
#: Below every score, and the largest component.
_FLOOR, _MOST = -(1 << 63), float(1 << 62)


def _quantised(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed = [], []
            for i, v in zip(column(batch, "vec_id").to_pylist(), column(batch, "v").to_pylist(), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    x = np.floor(scale * x)
                    if np.abs(x).max(initial=0) > _MOST:
                        raise OverflowError("a scaled component does not fit a long")
                    packed.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "q"])

    return run


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, q: floor(scale * x) of each component as packed 64-bit integers; rows that take no part are gone."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(_quantised(scale), "vec_id bigint, q binary")


def _matrix(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), max((len(p) // 8 for p in packed), default=0)), np.int64)
    for i, p in enumerate(packed):
        out[i, : len(p) // 8] = np.frombuffer(p, "<i8")
    return out


def _packed(x: np.ndarray) -> np.ndarray:
    """In the smallest integer type that holds it, for the shuffle."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int8 if most < 128 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _padded(x: np.ndarray, dim: int) -> np.ndarray:
    """Filled up with zeros to ``dim`` columns; as doubles, which multiply fastest, where these hold every component."""
    x = np.pad(x.astype(np.int64), ((0, 0), (0, dim - x.shape[1])))
    return x.astype(np.float64) if np.abs(x).max(initial=0) < 1 << 53 else x


def build_tree(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes as arrays: box (low, high), rows [start, end) of the reordered vectors, children (-1: a leaf), least id."""
    order = np.argsort(ids, kind="stable")
    start, end, left, right = [0], [len(ids)], [-1], [-1]
    todo = [0]
    while todo:
        node = todo.pop()
        rows = order[start[node] : end[node]]
        own = x[rows]
        spread = own.max(0) - own.min(0) if len(rows) else np.zeros(1)
        if len(rows) <= LEAF or not spread.any():
            order[start[node] : end[node]] = rows[np.argsort(ids[rows], kind="stable")]
            continue
        half = len(rows) // 2
        order[start[node] : end[node]] = rows[np.argpartition(own[:, spread.argmax()], half)]
        left[node], right[node] = len(start), len(start) + 1
        todo += [len(start), len(start) + 1]
        start += [start[node], start[node] + half]
        end += [start[node] + half, end[node]]
        left += [-1, -1]
        right += [-1, -1]
    x, ids = x[order], ids[order]
    spans = list(zip(start, end, strict=True))
    boxes = {"low": _packed(np.array([x[a:b].min(0) for a, b in spans])), "high": _packed(np.array([x[a:b].max(0) for a, b in spans]))}
    return boxes | {"ids": ids, "x": _packed(x), "start": np.array(start), "end": np.array(end), "left": np.array(left), "right": np.array(right), "least": np.array([ids[a:b].min() for a, b in spans])}


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in doubles or in 64-bit integers while these hold every sum, else in integers of
    any size, as which they are returned."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    return a @ b.T if most < 1 << 62 else a.astype(object) @ b.astype(object).T


def _long(x: np.ndarray) -> np.ndarray:
    if x.dtype == object and x.size and max(x.max(), -x.min()) >= 1 << 63:
        raise OverflowError("a score does not fit a long")
    return x.astype(np.int64)


class Search:
    """The k best candidates of a block of queries, over as many trees as are added."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, asks: np.ndarray | None = None):
        """floor: a score that at least k candidates elsewhere reach, for each query. asks: what tells queries of one id
        apart."""
        self.ids, self.q, self.k, self.floor = ids, q, k, floor
        self.asks = ids if asks is None else asks
        self.scores = np.full((len(ids), k), _FLOOR, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.kth, self.kth_id = floor.copy(), np.full(len(ids), np.iinfo(np.int64).max)
        self.looked = 0

    def run(self, trees: list[dict[str, np.ndarray]]) -> None:
        q, heap = self.q, []
        for t, tree in enumerate(trees):
            dim = max(q.shape[1], tree["x"].shape[1])
            trees[t] = tree | {n: _padded(m, dim) for n, m in (("x", tree["x"]), ("low", tree["low"]), ("high", tree["high"]), ("q", q))}
        plus, minus = [np.maximum(t["q"], 0) for t in trees], [np.minimum(t["q"], 0) for t in trees]

        def add(t: int, nodes: np.ndarray) -> None:
            tree = trees[t]
            bounds = _products(plus[t], tree["high"][nodes]) + _products(minus[t], tree["low"][nodes])
            if bounds.dtype == object:  # a bound may pass what a score can reach
                bounds = np.clip(bounds, -(1 << 63), (1 << 63) - 1).astype(np.int64)
            for node, bound in zip(nodes.tolist(), bounds.T, strict=True):
                live = self._live(bound, tree["least"][node])
                if live.any():
                    heapq.heappush(heap, (-int(bound[live].max()), t, node, bound))

        for t in range(len(trees)):
            add(t, np.array([0]))
        while heap:
            _, t, node, bound = heapq.heappop(heap)
            tree = trees[t]
            live = np.flatnonzero(self._live(bound, tree["least"][node]))
            if not len(live):
                continue
            if tree["left"][node] >= 0:
                add(t, np.array([tree["left"][node], tree["right"][node]]))
                continue
            self.looked += len(live) * int(tree["end"][node] - tree["start"][node])
            own = slice(tree["start"][node], tree["end"][node])
            self._offer(live, tree["ids"][own], _long(_products(tree["q"][live], tree["x"][own])))

    def _live(self, bound: np.ndarray, least: int) -> np.ndarray:
        return (bound > self.kth) | ((bound == self.kth) & (least < self.kth_id))

    def _offer(self, live: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        kth, kth_id = self.kth[live][:, None], self.kth_id[live][:, None]
        good = ((scores > kth) | ((scores == kth) & (ids[None] < kth_id))) & (ids[None] != self.ids[live][:, None])
        some = good.any(1)
        if not some.any():
            return
        live, good, scores = live[some], good[some], scores[some]
        all_scores = np.hstack([self.scores[live], np.where(good, scores, _FLOOR)])
        all_ids = np.hstack([self.found[live], np.where(good, ids[None], np.iinfo(np.int64).max)])
        best = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.k]  # ~x falls where x rises and overflows nowhere
        self.scores[live], self.found[live] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
        reached = self.scores[live, -1] > self.floor[live]
        self.kth[live] = np.maximum(self.scores[live, -1], self.floor[live])
        self.kth_id[live] = np.where(reached | (self.scores[live, -1] == self.floor[live]), self.found[live, -1], np.iinfo(np.int64).max)

    def rows(self) -> pd.DataFrame:
        some = self.found != np.iinfo(np.int64).max
        return pd.DataFrame({"ask": np.repeat(self.asks, self.k)[some.ravel()], "query_id": np.repeat(self.ids, self.k)[some.ravel()], "vec_id": self.found[some], "score": self.scores[some]})


def _trees(part: pd.DataFrame) -> pd.DataFrame:
    tree = build_tree(part["vec_id"].to_numpy(np.int64), _matrix(part["q"].tolist()))
    return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "tree": [pickle.dumps(tree, 5)]})


def top_k(vectors: DataFrame, queries: Column, k: int, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` (a condition on vec_id) admits, the k other rows
    with the largest integer inner products, ties to the smaller vec_id. Rows of one id with different vectors ask apart
    and have their own ranks; rows that repeat both ask once."""
    rows = scratch(quantised(vectors, scale), "quantised")
    total, asked = rows.count(), rows.where(queries).count()
    shards, blocks = max(1, -(-total // SHARD)), max(1, -(-asked // BLOCK), min(-(-asked // LEAST_BLOCK), vectors.sparkSession.sparkContext.defaultParallelism))
    spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    trees = scratch(rows.withColumn("shard", spread("shard", shards)).groupBy("shard").applyInPandas(_trees, "shard int, tree binary"), "trees")
    asks = rows.where(queries).dropDuplicates(["vec_id", "q"]).withColumn("block", spread("block", blocks))
    asks = scratch(asks.withColumn("ask", F.monotonically_increasing_id()), "asks")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"ask": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = Search(left["vec_id"].to_numpy(np.int64), _matrix(left["q"].tolist()), k, left["floor"].to_numpy(np.int64), left["ask"].to_numpy(np.int64))
        found.run([pickle.loads(t) for t in right["tree"]])
        return found.rows()

    def against(asks: DataFrame, some: DataFrame) -> DataFrame:
        """Each block of queries against each group of shards."""
        groups = F.floor(F.col("shard") / SHARDS_PER_TASK).cast("int")
        dealt = some.withColumn("part", groups).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        parts = -(-shards // SHARDS_PER_TASK)
        copies = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ("block", "part")
        return copies.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(search, "ask bigint, query_id bigint, vec_id bigint, score bigint")

    first = trees.where(F.col("shard") < SHARDS_PER_TASK)
    found = against(asks.withColumn("floor", F.lit(_FLOOR).cast("bigint")), first)
    if shards > SHARDS_PER_TASK:
        found = scratch(found, "first-shards")
        kth = found.groupBy("ask").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(_FLOOR).cast("bigint")).alias("floor"))
        seeded = asks.join(kth, "ask", "left").select("ask", "vec_id", "q", "block", F.coalesce("floor", F.lit(_FLOOR).cast("bigint")).alias("floor"))
        found = found.unionByName(against(seeded, trees.where(F.col("shard") >= SHARDS_PER_TASK)))
    rank = F.row_number().over(W.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
