"""Quality by co-training: a classifier of the text and one of the metadata teach each other.

Each view is a logistic regression: over measures of the whole text (shares of symbols, digits, capitals, repeated
words and lines, ...), and over the metadata (source, language, length) as hashed indicators. Both start from the
labelled sample; in each round each one labels the documents of an unlabelled pool of which it is surest, and these
join the other one's examples. At the end each view is calibrated on labelled documents kept out of the training, and
a last regression over the two calibrated log-odds gives the score of a document, 0 to 1, of being of good quality.

Only measures leave the executors: a bounded number of rows of about a hundred numbers, one for each id (of rows that share
an id, the least by their measures). Every document is scored.

Defined cases: a null text is an empty one; null metadata have their own indicators; without examples of both classes
every score is 1 (nothing is rejected); repeated rows and null ids are kept as rows; an empty table gives an empty result;
other columns are passed through by ``score``, those it adds replace columns of the same name.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import append_columns, column, logistic, scratch, sigmoid, texts, unit_hash

#: The training sample: labelled documents of each class, and documents of the unlabelled pool.
DOCS_PER_CLASS, POOL = 3_000, 6_000
ROUNDS, SHARE_PER_ROUND, SURE = 5, 0.05, 0.9
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16
N_TEXT, N_META = 14, 3 + SOURCE_BUCKETS + LANG_BUCKETS


@dataclass(frozen=True)
class View:
    """x -> (x - mean) / scale, clipped, with squares if asked for; then weights, then the calibration's slope and offset."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def shape(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z]) if x.shape[1] == N_TEXT else z

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (self.shape(x) @ self.weights[:-1] + self.weights[-1]) + self.offset


@dataclass(frozen=True)
class Model:
    text: View | None = None
    meta: View | None = None
    combine: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> np.ndarray:
        """Columns: score, text_score, meta_score."""
        if self.text is None:
            return np.ones((len(x_text), 3))
        a, b = self.text.logit(x_text), self.meta.logit(x_meta)
        return np.stack([sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2]), sigmoid(a), sigmoid(b)], 1)


_UPPER, _DIGIT, _SYMBOL, _STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]=_~^\\/@+", b".,;:!?"


def text_measures(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    share = lambda drop: (len(text) - len(text.translate(None, drop))) / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    return [
        math.log1p(len(words)),
        chars / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        share(_SYMBOL),
        share(b"|"),
        share(b"!"),
        share(_UPPER),
        share(_DIGIT),
        share(_STOP),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        (len(text) - len(text.decode(errors="replace"))) / chars,
    ]


def meta_measures(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(N_META)
    size = math.log1p(max(0, n_chars or 0))
    out[:3] = size, size * size / 10, n_chars is None
    out[3 + zlib.crc32(repr(source).encode()) % SOURCE_BUCKETS] = 1
    out[3 + SOURCE_BUCKETS + zlib.crc32(repr(lang).encode()) % LANG_BUCKETS] = 1
    return out


def measure(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch."""
    x = np.array([text_measures(t) for t in texts(batch)], float).reshape(batch.num_rows, N_TEXT)
    source, lang, n_chars = (column(batch, c).to_pylist() for c in ("source", "lang", "n_chars"))
    return x, np.array([meta_measures(*m) for m in zip(source, lang, n_chars, strict=True)], float).reshape(batch.num_rows, N_META)


def _narrow(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    return docs.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def _fit_view(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> View:
    view = View(x.mean(0), np.maximum(x.std(0), 1e-3 if x.shape[1] == N_TEXT else 0.05), np.zeros(0))
    return View(view.mean, view.scale, logistic(view.shape(x), y, c, ridge=2.0))


def co_train(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], real: dict[int, float]) -> Model:
    """x, pool: the two views of the labelled and of the unlabelled examples; real: the classes' shares among all labels."""
    if len(set(y.tolist())) < 2:
        return Model()
    held = np.arange(len(y)) % 4 == 3
    train = ~held
    for c in (0, 1):  # a class that a quarter leaves out of either part gives its last example to calibrate; a single one does both
        at = np.flatnonzero(y == c)
        if held[at].all() or not held[at].any():
            held[at], train[at] = False, True
            held[at[-1]], train[at[-1]] = True, len(at) == 1
    cost = np.array([real[c] * len(y) / (y == c).sum() for c in y])
    own = [[(x[v][train], y[train], cost[train])] for v in (0, 1)]
    free = np.ones(len(pool[0]), bool)
    joined = lambda v: tuple(np.concatenate(part) for part in zip(*own[v], strict=True))
    for _ in range(ROUNDS):
        for v in (0, 1):
            view = _fit_view(*joined(v))
            p = sigmoid(view.logit(pool[v])) if len(pool[v]) else np.zeros(0)
            for label, sure in ((1, p), (0, 1 - p)):
                ready = np.flatnonzero(free & (sure >= SURE))
                picked = ready[np.argsort(-sure[ready], kind="stable")[: max(1, int(SHARE_PER_ROUND * real[label] * len(p)))]]
                if len(picked):
                    free[picked] = False
                    own[1 - v].append((pool[1 - v][picked], np.full(len(picked), label), np.full(len(picked), 0.5)))
    views = []
    for v in (0, 1):
        view = _fit_view(*joined(v))
        slope, offset = logistic(view.logit(x[v][held])[:, None], y[held], cost[held], ridge=0.1)
        views.append(View(view.mean, view.scale, view.weights, float(slope), float(offset)))
    both = np.stack([view.logit(x[v][held]) for v, view in enumerate(views)], 1)
    return Model(views[0], views[1], tuple(logistic(both, y[held], cost[held], ridge=0.1).tolist()))


def fit(docs: DataFrame, labels: DataFrame, admitted: Column, docs_per_class: int = DOCS_PER_CLASS, pool: int = POOL) -> Model:
    """Learn from labelled documents whose doc_id ``admitted`` admits, and from a pool without labels. Both samples are
    bounded and repeatable (the smallest hashes of the ids); the lists of their ids are broadcast to find the texts."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    share = unit_hash(F.col("doc_id"), "quality sample")
    sizes = {r["y"]: r["count"] for r in known.where(admitted).groupBy("y").count().collect()}
    limit = F.when(F.col("y") == 1, docs_per_class / max(1, sizes.get(1, 0))).otherwise(docs_per_class / max(1, sizes.get(0, 0)))
    labelled = known.where(admitted).where(share < limit)
    total = docs.count()
    spare = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where(admitted).where(unit_hash(F.col("doc_id"), "quality pool") < pool / max(1, total))
    wanted = labelled.unionByName(spare.join(known, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("y")))
    sample = scratch(wanted.groupBy("doc_id").agg(F.max("y").alias("y")), "quality-sample")
    found = _narrow(docs).join(F.broadcast(sample), "doc_id")

    def both(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(list(np.hstack(measure(batch))), pa.list_(pa.float64()))]

    # one row of each id, so that the rows collected are as bounded as the sample is
    rows = append_columns(found, both, [("x", "array<double>")]).groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), N_TEXT + N_META)
    y = np.array([r["y"] for r in rows], int)
    order = np.argsort([zlib.crc32(str(r["doc_id"]).encode()) for r in rows], kind="stable") if rows else np.zeros(0, int)
    x, y = x[order], y[order]
    n = sum(sizes.values())
    part = lambda which: [x[which][:, :N_TEXT], x[which][:, N_TEXT:]]
    return co_train(part(y >= 0), y[y >= 0], part(y < 0), {c: sizes.get(c, 0) / max(1, n) for c in (0, 1)})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score, text_score and meta_score (all 0 to 1, higher: better quality). A map, no shuffle."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    cast = [F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in docs.columns]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = model.scores(*measure(batch))
        return [pa.array(scores[:, k]) for k in range(3)]

    return append_columns(docs.select(*cast), run, [("quality_score", "double"), ("text_score", "double"), ("meta_score", "double")])
