"""Personal data by candidate gradient boosting.

Base spans follow fixed formats and always stay. High-recall generators then propose overlapping spans around them and
elsewhere: windows of digit groups, dotted groups, addresses written out. Boosted trees judge a proposal from features of
its format and of its context, and a proposal is redacted if its calibrated probability reaches its kind's threshold.

There are no labels for spans, so the trees learn from a bounded sample of texts that the formats label: a base span is
right, what overlaps one or failed a check is wrong, everything else is left out. Variants made from the sample's spans
(written-out addresses, other groupings, two numbers run together, a wrong digit, dates and plain counts in their place)
teach what the formats miss. A quarter of the sampled texts is kept from the trees, calibrates their margins and sets
each kind's threshold.

Defined results: a null or empty text has no spans; bytes that are no UTF-8 count as U+FFFD; repeated rows give equal rows;
a table without candidates has base spans only; spans that tie go to the earlier and longer one; positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import append_columns, logistic, ship, sigmoid, texts

KINDS = ("email", "ip", "card", "phone")
#: Distinct texts that the trees learn from, and proposals that one of them may give.
SAMPLE = 4_000
PER_TEXT = 60
#: Least share of right spans among those that a threshold lets through, on the texts kept from the trees.
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SITE = re.compile(r"[0-9@]|[(\[]at[)\]]| dot ")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _valid(kind: int, text: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in text.split("."))
    digits = _NOT_DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the fixed formats, and matches that failed their check, both by start and kind. Linear in the text: a
    search that would try every start within a run of characters starts at the run's ends instead."""
    good, bad = [], []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            good.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            (good if _valid(kind, m.group()) else bad).append((m.start(), kind, m.end()))
    return sorted(good), sorted(bad)


_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]++ ?(?:[(\[]at[)\]]|@) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)+|[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)+")
_CLUSTER = re.compile(r"[+(]{0,2}[0-9]++(?:[ ().\[\]-]{1,3}[0-9]++)*")
_GROUP = re.compile(r"[0-9]++")


def proposals(text: str) -> list[Span]:
    """Overlapping spans that may be personal data: written-out and plain addresses, and in every cluster of digits the
    windows of a few groups whose number of digits suits a kind."""
    out = [(m.start(), 0, m.end()) for m in _WRITTEN.finditer(text)] if "@" in text or _SITE.search(text) else []
    for m in _CLUSTER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, min(i + 6, len(groups))):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                end = groups[j][1]
                if j == i + 3 and digits <= 12:
                    out.append((start, 1, end))
                if digits >= 12 and j < i + 5:
                    out.append((start, 2, end))
                if 7 <= digits <= 15:
                    before = start
                    while before > m.start() and text[before - 1] in "+(":
                        before -= 1
                        out.append((before, 3, end))
                    out.append((start, 3, end))
    return out


_CUES = [re.compile(p) for p in (r"tel|phone|call|fax|mobil", r"card|visa|pay|credit", r"\bip\b|host|server|addr", r"mail|contact|write", r"order|\bid\b|\bno\b|isbn|version|date|page|token|key")]


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3 if c in ".@+-/_" else 4


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal as numbers."""
    start, kind, end = span
    body = text[start:end]
    groups = [g for g in _NOT_DIGIT.split(body) if g]
    gaps = [g for g in re.split(r"[0-9A-Za-z]+", body) if g]
    digits = "".join(groups)
    near, after = text[max(0, start - 24) : start], text[end : end + 24]
    lengths = [len(g) for g in groups] or [0]
    labels = re.split(r" ?(?:\.|[(\[]dot[)\]]| dot ) ?", body) if kind == 0 else [""]
    left, right = near.rstrip(" ().[]-+")[-1:], after.lstrip(" ().[]-")[:1]
    cue = near.lower()
    return [
        *(float(kind == k) for k in range(4)), len(body), len(digits), len(groups), max(lengths), min(lengths), lengths[0], lengths[-1], len(set(gaps)),
        float(body.startswith("+")), body.count("(") - body.count(")"), float(luhn(digits)) if digits else 0.0, max((int(g) for g in groups if len(g) < 10), default=0),
        float(any(len(g) > 1 and g[0] == "0" for g in groups)), body.count("."), body.count("-"), body.count(" "), body.count("@"), body.count("["), len(labels), len(labels[-1]),
        _side(near[-1:]), _side(after[:1]), _side(left), _side(right), sum(c.isdigit() for c in near), sum(c.isdigit() for c in after), *(float(bool(p.search(cue))) for p in _CUES),
    ]


def _labelled(text: str, right: set[Span], wrong: set[Span], unknown: list[Span]) -> list[tuple[list[float], int, int]]:
    """(features, label, kind) of the proposals of ``text`` whose label is known: equal to a right or wrong span, or
    overlapping a right one. Proposals inside a failed match are left out, since they may be right."""
    out = []
    for p in proposals(text)[:PER_TEXT]:
        if p in right:
            label = 1
        elif p in wrong or any(p[0] < e and s < p[2] for s, _, e in right):
            label = 0
        else:
            continue
        if label or p in wrong or not any(s <= p[0] and p[2] <= e for s, _, e in unknown):
            out.append((features(text, p), label, p[1]))
    return out


def _variants(body: str, kind: int, draw: Random) -> list[tuple[str, list[tuple[str, int]], list[tuple[str, int]]]]:
    """(text to stand in the place of a base span, its right parts, its wrong parts), each part with its kind."""
    digits = _NOT_DIGIT.sub("", body)
    fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
    if kind == 0:
        name, host = body.split("@", 1)
        forms = (f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} at {host.replace('.', ' dot ')}", f"{name} @ {host}")
        return [(f, [(f, 0)], []) for f in forms]
    if kind == 1:
        parts = body.split(".")
        high = ".".join([str(256 + draw.randrange(700)), *parts[1:]])
        more = f"{draw.randrange(90)}.{body}"
        return [("[.]".join(parts), [("[.]".join(parts), 1)], []), (high, [], [(high, 1)]), (more, [], [(more.rsplit(".", 1)[0], 1), (body, 1), (body, 3)])]
    if kind == 2:
        other = "".join(str(draw.randrange(10)) for _ in range(15))
        other = next(other + c for c in "0123456789" if luhn(other + c))
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + draw.randrange(8)) % 10)
        forms = [(s.join(fours), [(s.join(fours), 2)], []) for s in (" ", "-", ".")]
        return [*forms, (f"{body} {other}", [(body, 2), (other, 2)], []), (wrong, [], [(wrong, 2), (wrong, 3)]), ("-".join(fours[:-1]) + f"-{wrong[-len(fours[-1]):]}", [], [("-".join(fours[:-1]) + f"-{wrong[-len(fours[-1]):]}", 2)])]
    local = body[1:].split(" ", 1)[-1] if " " in body else body[1:]
    plain = "-".join([digits[-10:-7], digits[-7:-4], digits[-4:]])
    out = [(f, [(f, 3)], []) for f in (body[1:], local, plain) if 9 < sum(c.isdigit() for c in f) < 16]
    date = f"20{draw.randrange(10, 30)}-{draw.randrange(10, 13)}-{draw.randrange(10, 29)}"
    counts = " ".join(str(draw.randrange(1, 999)) for _ in range(6))
    bare = str(draw.randrange(10**9, 10**13))
    return [*out, (f"{body} {4_000_000_000_000_006}", [(body, 3), ("4000000000000006", 2)], []), (date, [], [(date, 3)]), (counts, [], [(counts, 3), (counts, 2), (counts.rsplit(" ", 2)[0], 3)]), (bare, [], [(bare, 3), (bare, 2)])]


def examples(text: str, seed: int) -> list[tuple[list[float], int, int]]:
    """Labelled proposals of a text and of variants of its base spans."""
    good, bad = base_spans(text)
    out = _labelled(text, set(good), set(bad), bad)
    draw = Random(seed)
    for start, kind, end in good[:8]:
        before, after = text[max(0, start - 60) : start].rstrip("+0123456789()-."), text[end : end + 60].lstrip("0123456789()-.")
        for body, right, wrong in _variants(text[start:end], kind, draw):
            made, at = f"{before} {body}{after}", len(before) + 1
            place = [{(at + body.find(b), k, at + body.find(b) + len(b)) for b, k in part} for part in (right, wrong)]
            out += _labelled(made, place[0], place[1], [])
    return out


@dataclass
class Trees:
    """Boosted trees of depth ``depth``: split features and cuts by node, leaf values; a line calibrates the margin."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)
    threshold: tuple[float, ...] = (1.1,) * len(KINDS)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (v.size - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.line[0] * self.margin(x) + self.line[1])


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Gradient boosting of the logistic loss: each split is the best one over cuts at quantiles of the features, from
    histograms of first and second derivatives."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T, strict=True)], 1)
    margin, inner = np.zeros(len(x)), 2**depth - 1
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = sigmoid(margin)
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            total_g, total_h = np.bincount(at, g, width), np.bincount(at, h, width)
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                n = len(cuts[f]) + 1
                left_g, left_h = (np.bincount(at * n + binned[:, f], w, width * n).reshape(width, n).cumsum(1)[:, :-1] for w in (g, h))
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                model.feature[t, first : first + width][better] = f
                model.cut[t, first : first + width][better] = cuts[f][k[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), model.feature[t][node]] > model.cut[t][node])
        leaf = node - inner
        model.leaf[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += model.leaf[t][leaf]
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float) -> None:
    """The line from margins to probabilities, and of each kind the least threshold above a half whose spans are right
    often enough, as far as the examples show (one more wrong one is assumed); kinds without such a threshold add none."""
    w = logistic(model.margin(x)[:, None], y)
    model.line = (float(w[0]), float(w[1]))
    p, found = model.probability(x), []
    for k in range(len(KINDS)):
        order = np.argsort(-p[kind == k], kind="stable")
        q, right = p[kind == k][order], y[kind == k][order]
        fair = (q >= 0.5) & (right.cumsum() / (np.arange(len(q)) + 2) >= precision) & np.append(q[1:] < q[:-1], True)[: len(q)]
        found.append(float(q[fair].min()) if fair.any() else 1.1)
    model.threshold = tuple(found)


def fit(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Trees | None:
    """Trees from at most ``sample`` distinct texts with digits or addresses, those with the least hashes; copies count
    once. None if no text has labelled proposals of both labels."""
    ship(docs.sparkSession)
    sites = docs.where(F.col("text").rlike("[0-9]{3}|@")).select(F.xxhash64("text").alias("key"), "text")
    keys = [r.key for r in sites.select("key").distinct().orderBy("key").limit(sample).collect()]
    if not keys:
        return None
    some = sites.where(F.col("key") <= max(keys)).groupBy("key").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, *e) for key, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for e in examples(text.decode("utf-8", "replace"), key)]
            if found:
                key, x, y, kind = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(kind, pa.int32())], ["key", "x", "y", "kind"])

    found = some.mapInArrow(run, "key bigint, x array<double>, y int, kind int").toArrow().sort_by([("key", "ascending"), ("kind", "ascending"), ("y", "ascending")])
    if not found.num_rows:
        return None
    x, y, kind = np.array(found["x"].to_pylist()), found["y"].to_numpy().astype(float), found["kind"].to_numpy()
    kept = found["key"].to_numpy() % 4 == 0
    if min(len(set(y[kept])), len(set(y[~kept]))) < 2:
        return None
    model = boost(x[~kept], y[~kept])
    calibrate(model, x[kept], y[kept], kind[kept], precision)
    return model


def added_spans(text: str, base: list[Span], model: Trees | None) -> list[Span]:
    """Proposals that reach their threshold and overlap neither a base span nor a surer one."""
    if model is None:
        return []
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    free = sorted({p for p in proposals(text) if not ((k := bisect_left(starts, p[2])) and ends[k - 1] > p[0])})
    if not free:
        return []
    chance = model.probability(np.array([features(text, f) for f in free]))
    sure = sorted((-q, s, -e, kind) for q, (s, kind, e) in zip(chance.tolist(), free, strict=True) if q >= model.threshold[kind])
    out: list[Span] = []
    for _, start, end, kind in sure:
        k = bisect_left(out, (-end, 0, 0))  # all that start before this one ends; the last of them ends last
        if not (k and out[k - 1][2] > start):
            insort(out, (start, kind, -end))
    return out


def find(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone and base_sha256 (of the base spans), and spans (all of them), a span
    written as kind:start:end."""

    def line(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, spans = [], []
        for raw in texts(batch):
            text = raw.decode("utf-8", "replace") if raw else ""
            base = base_spans(text)[0] if _SITE.search(text) else []
            for k, c in enumerate(counts):
                c.append(sum(kind == k for _, kind, _ in base))
            digests.append(hashlib.sha256(line(base).encode()).hexdigest())
            spans.append(line(base + added_spans(text, base, model)) if base or _SITE.search(text) else "")
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)]

    return append_columns(docs, make, [*((f"n_{k}", "bigint") for k in KINDS), ("base_sha256", "string"), ("spans", "string")])


def redact(docs: DataFrame, model: Trees | None, mask: str = "<{}>") -> DataFrame:
    """``docs`` with ``redacted``: the text with each span replaced by its kind; of overlapping spans the first counts."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for raw in texts(batch):
            text = raw.decode("utf-8", "replace") if raw is not None else None
            if text:
                base = base_spans(text)[0]
                parts, at = [], 0
                for start, kind, end in sorted(base + added_spans(text, base, model), key=lambda s: (s[0], -s[2])):
                    if start >= at:
                        parts += [text[at:start], mask.format(KINDS[kind])]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return [pa.array(out, pa.string())]

    return append_columns(docs, make, [("redacted", "string")])
