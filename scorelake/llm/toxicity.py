"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

``fit`` takes a bounded sample of labelled documents (DOCS_PER_CLASS, SAMPLE_CHARS), near copies counted once. Insults
are strewn singly into other text, so most of a toxic document is ordinary: byte n-grams of words that far more toxic
than ordinary documents have (a likelihood-ratio test) tell which of its words are not, and runs of two and three
words are tested alike. These parts of each toxic document are a training sample of the toxic dictionary; passages of
ordinary documents, at most PASSAGES, are those of the ordinary one; zstandard trains both. A part that the trained
toxic dictionary leaves out is put in front of it, so that none is cut, and so is a word of many ordinary documents
that the ordinary one leaves out. Both are used as plain content, so that a
window's two compressed lengths differ only by what the dictionaries hold.

Windows are single words and overlapping runs of RUN words. Words end at Unicode white space and at ASCII punctuation;
one of more than PIECE bytes, such as a text without spaces, is cut into overlapping pieces that count as words. A
word's gain is its ordinary minus its toxic length; thresholds on the gain, others for words that lie in the toxic
dictionary as a whole than for the rest, sort the words into classes. A document's measures are how many of its
distinct words reach each class, and the runs' largest gain (the toxic dictionary put behind the ordinary one) and how
many reach each threshold. A logistic
calibration turns them into a score; it is fitted on documents (CALIBRATED of each class at most) measured with
dictionaries of the other two thirds of the sample, and its bias is set so that 0.5 is the threshold with the fewest
errors. The final dictionaries come from the whole sample. A worker remembers the classes of words it has seen lately.

Defined cases: a null or empty text scores as one without gains; without toxic or without ordinary examples every score
is 0; repeated rows and null ids are kept as rows; an empty table gives an empty result; other columns are left out.
Whole texts are scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Recent, bounded_rows, column, logistic, ship, sigmoid, slices, texts, unit_hash

#: The training sample: documents of each class, characters of each class, and documents of each class that calibrate.
DOCS_PER_CLASS, SAMPLE_CHARS, CALIBRATED = 3_000, 12_000_000, 1_500
GRAMS = (4, 5, 6, 7, 8, 10)
#: The dictionaries' least size for training, passages of eight words that train the ordinary one, and toxic documents
#: of the sample that a mark or a marked part needs.
DICTIONARY, PASSAGES, LEAST = 16_384, 30_000, 3
#: Share of ordinary documents from which on a word must be in the ordinary dictionary.
USUAL = 0.003
#: Words of a run. Greatest length of a word, and lengths and distances of the pieces of longer ones, in bytes: short ones
#: so that little else is in a piece with an insult, and others for long insults.
RUN, OVERLAP, PIECE, PIECES = 12, 3, 24, ((12, 4), (24, 8))
#: Thresholds of the gain for words that lie in the toxic dictionary, for others, and for runs.
INSIDE, BESIDE, RUN_GAINS = (2, 3, 4, 6), (3, 5), (3, 6)
CLASSES = len(INSIDE) + len(BESIDE)
#: Hash slots by which documents are counted, and the least likelihood ratio of a mark.
SLOT_BITS, SIGNIFICANT = 22, 24.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stands between words and around windows; two bytes tell a whole word better from a part of one.
SPACES = b"  "
AT_ONCE, REMEMBERED = 2 << 20, 250_000
#: Ends each window and both dictionaries. zstandard looks for no match in the last 8 bytes, and pays for its table of
#: matches once; with this, a window always has a match, and one more costs only its own code.
TAIL = bytes(range(1, 9)) + bytes(range(14, 32))
#: A strategy that puts every position of a dictionary into its tables, unlike the fastest ones.
_SEARCH = dict(strategy=zstd.STRATEGY_GREEDY, window_log=15, chain_log=14, hash_log=14, search_log=6, min_match=5, target_length=16)
_PARAMETERS = dict(write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)


#: ASCII punctuation but apostrophes and hyphens separates words.
_APART = bytes(32 if c in b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    #: Compressed length of a window that lies in the toxic dictionary as a whole.
    whole: int
    weights: tuple[float, ...]


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words between white space and punctuation, long ones in overlapping pieces."""
    words = (text or b"").decode(errors="replace").lower()
    words = words.encode().translate(_APART).split() if words.isascii() else [w for x in words.split() for w in x.encode().translate(_APART).split()]
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [x for w in words for x in ([w] if len(w) <= PIECE else [w[i : i + n] for n, step in PIECES for i in range(0, len(w) - n + step, step)])]


def runs_of(words: list[bytes]) -> list[bytes]:
    """Runs of RUN words that share OVERLAP words with the next one; none of a single word."""
    if len(words) < 2:
        return []
    return [SPACES.join(words[i : i + RUN]) for i in range(0, max(1, len(words) - OVERLAP), RUN - OVERLAP)]


def _lengths(found: list[bytes], dictionary: bytes, log: int) -> np.ndarray:
    """Compressed length of each window; all windows in one call. 1 << log: positions of its tables."""
    parameters = zstd.ZstdCompressionParameters(**_SEARCH | dict(window_log=log + 1, chain_log=log, hash_log=log), **_PARAMETERS)
    padded = [SPACES + w + SPACES + TAIL for w in found]
    n = np.fromiter(map(len, padded), np.uint64, len(padded))
    segments = np.stack([np.cumsum(n) - n, n], 1).astype(np.uint64)
    content = zstd.ZstdCompressionDict(dictionary + TAIL, zstd.DICT_TYPE_RAWCONTENT)
    result = zstd.ZstdCompressor(dict_data=content, compression_params=parameters).multi_compress_to_buffer(zstd.BufferWithSegments(b"".join(padded), segments.tobytes()), threads=1)
    return np.fromiter(map(len, result), np.int64, len(found))


def lengths(found: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each window's compressed length with the ordinary and with the toxic dictionary."""
    if not found or not model.toxic or not model.ordinary:
        return np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    log = max(_SEARCH["hash_log"], max(len(model.toxic), len(model.ordinary)).bit_length())
    return _lengths(found, model.ordinary, log), _lengths(found, model.toxic, log)


def classes(ordinary: np.ndarray, toxic: np.ndarray, whole: int) -> np.ndarray:
    """The class of each word window: 0 for small gains, else by whether the toxic length is that of a window that lies
    in the dictionary as a whole (``whole``), and by the thresholds that the gain reaches."""
    gain = ordinary - toxic
    inside = toxic <= whole
    return np.where(inside, np.searchsorted(INSIDE, gain, "right"), np.where(gain >= BESIDE[0], len(INSIDE) + np.searchsorted(BESIDE, gain, "right"), 0))


def measures(kinds: list[int], run_gains: list[int]) -> list[float]:
    """Of one document: for each class of words how many reach it or a higher one of its kind, as a log and in relation
    to the spread that chance gives in a document of its length; then the runs' largest gain and, for each threshold,
    how many reach it."""
    counts = np.bincount(np.array(kinds or [0]), minlength=CLASSES + 1)[1:]
    inside, beside = (np.cumsum(part[::-1])[::-1] for part in (counts[: len(INSIDE)], counts[len(INSIDE) :]))
    reach = np.concatenate([inside, beside])
    g = np.array(run_gains or [0])
    top = float(min(max(g.max(), 0), 16)) / 4
    return [*np.log1p(reach), *(5 * reach / math.sqrt(20 + len(kinds))), top, *(math.log1p(int((g >= t).sum())) for t in RUN_GAINS)]


def _slots(joined: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, start and length of each n-gram of ``sizes`` bytes of a text of words between spaces; a space is in an
    n-gram as its first or last byte only."""
    spaces = np.flatnonzero(joined == 32)
    until = np.full(len(joined), len(joined) - 1)
    until[:] = spaces[np.minimum(np.searchsorted(spaces, np.arange(len(joined)), "right"), len(spaces) - 1)]
    h = np.zeros(len(joined), np.uint64)
    wide = joined.astype(np.uint64) + np.uint64(1)
    out = []
    for n in range(1, max(sizes) + 1):
        m = len(joined) - n + 1
        if m < 1:
            break
        h = h[:m] * _ODD + wide[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(np.arange(m) + n - 1 <= until[:m])
            out.append((((h[at] + np.uint64(n)) * _ODD >> np.uint64(64 - SLOT_BITS)).astype(np.int64), at, np.full(len(at), n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _run_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, first word and number of words of each run of two and of three words."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    out = [(np.zeros(0, np.int64),) * 3]
    for n in (2, 3):
        m = len(words) - n + 1
        if m > 0:
            mixed = sum(h[i : i + m] * (_ODD ** (i + 1)) for i in range(n)) + np.uint64(n)
            out.append(((mixed * _ODD >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(m), np.full(m, n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _once(docs: list[list[bytes]]) -> list[list[bytes]]:
    """One of the documents that share the least hash of their runs of three words."""
    seen: dict[int, list[bytes]] = {}
    for words in docs:
        if words:
            slot, _, n = _run_slots(words)
            seen.setdefault(int(slot[n == 3].min()) if len(words) > 2 else -1 - zlib.crc32(b" ".join(words)), words)
    return list(seen.values())


def _excess(n: np.ndarray, m: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Whether n of n1 toxic and m of n0 ordinary documents are far more than equal shares: the likelihood ratio of two
    rates against one, and a ratio of nine between the rates."""
    p = n1 / (n1 + n0)
    g = n * np.log(np.maximum(n, 1) / np.maximum((n + m) * p, 1e-9)) + m * np.log(np.maximum(m, 1) / np.maximum((n + m) * (1 - p), 1e-9))
    return (n >= LEAST) & (2 * g > SIGNIFICANT) & (n / n1 > 9 * (m + 0.5) / n0)


def likely_parts(toxic: list, ordinary: list, slots: Callable, cut: Callable) -> tuple[list[set], list[set]]:
    """Of each toxic and of each ordinary document the parts that may be marks. ``slots`` gives a document's parts with
    their hash slots, ``cut`` the bytes of a part. Documents are counted by slot, so that the bytes of few parts only are
    looked at; what shares a slot with other parts is taken for likely more often, never less."""
    counts = np.zeros((2, 1 << SLOT_BITS), np.int32)
    last = np.zeros(1 << SLOT_BITS, np.int32)
    for c, docs in ((1, toxic), (0, ordinary)):
        for d in docs:
            s = slots(d)[0]
            last[s] = np.arange(len(s))
            counts[c, s[last[s] == np.arange(len(s))]] += 1
    likely = (counts[1] >= LEAST) & (counts[1] / len(toxic) > 4 * (counts[0] + 0.5) / len(ordinary))
    out: tuple[list[set], list[set]] = ([], [])
    for c, docs in enumerate((toxic, ordinary)):
        for d in docs:
            s, at, n = slots(d)
            good = np.flatnonzero(likely[s])
            out[c].append({cut(d, i, k) for i, k in zip(at[good].tolist(), n[good].tolist(), strict=True)})
    return out


def marks(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> set[bytes]:
    """The parts that far more of the toxic than of the ordinary documents have."""
    here, there = (Counter(chain.from_iterable(x)) for x in (toxic, ordinary))
    parts = list(here)
    n, m = (np.array([t[x] for x in parts], float) for t in (here, there))
    return {parts[i] for i in np.flatnonzero(_excess(n, m, len(toxic), len(ordinary)))} if parts else set()


def _joined(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b" " + b" ".join(sorted(set(words))) + b" ", np.uint8)


def _gram_and_word(joined: np.ndarray, i: int, n: int) -> tuple[bytes, bytes]:
    raw = joined.tobytes()
    return raw[i : i + n], raw[raw.rfind(b" ", 0, i + 1) + 1 : raw.find(b" ", i + 1)]


@dataclass(frozen=True)
class Sample:
    """Documents of one class: words, and what may be marks, n-grams (each with its word) and runs of words."""

    words: list[list[bytes]]
    grams: list[set[tuple[bytes, bytes]]]
    runs: list[set[bytes]]

    def some(self, keep: Callable[[int], bool]) -> Sample:
        return Sample(*([x for i, x in enumerate(part) if keep(i)] for part in (self.words, self.grams, self.runs)))


def samples(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[Sample, Sample]:
    flat = [[_joined(w) for w in docs] for docs in (toxic, ordinary)]
    grams = likely_parts(*flat, lambda d: _slots(d, GRAMS), _gram_and_word)
    runs = likely_parts(toxic, ordinary, _run_slots, lambda d, i, n: b" ".join(d[i : i + n]))
    return Sample(toxic, grams[0], runs[0]), Sample(ordinary, grams[1], runs[1])


def chosen_parts(toxic: Sample, ordinary: Sample) -> list[list[bytes]]:
    """What of each toxic document trains the toxic dictionary: words that hold a marked n-gram and are far more
    frequent in toxic documents, and marked runs of words without marked n-grams."""
    marked = marks(*([{g for g, _ in found} for found in x.grams] for x in (toxic, ordinary)))
    n1, n0 = len(toxic.words), len(ordinary.words)
    holding = {w for found in toxic.grams for g, w in found if g in marked}
    here, there = (Counter(w for words in x.words for w in holding.intersection(words)) for x in (toxic, ordinary))
    own = {w for w in holding if here[w] >= 2 and here[w] / n1 > 9 * (there[w] + 0.5) / n0}
    # a marked word would mark the words around it
    runs = {r for r in marks(toxic.runs, ordinary.runs) if not holding.intersection(r.split(b" "))}
    return [sorted(SPACES + x.replace(b" ", SPACES) + SPACES for x in own.intersection(words) | (runs & found)) for words, found in zip(toxic.words, toxic.runs, strict=True)]


def dictionaries(toxic: Sample, ordinary: Sample) -> tuple[bytes, bytes, int]:
    """Contents of the toxic and of the ordinary dictionary, and the toxic length of windows that lie in the former."""
    parts = chosen_parts(toxic, ordinary)
    count = Counter(chain.from_iterable(parts))
    if not count:
        return b"", b"", 0
    chosen = sorted(count, key=lambda w: (count[w], w))
    passages = [SPACES + SPACES.join(words[i : i + 8]) + SPACES for words in ordinary.words for i in range(0, len(words), 8)]
    passages.sort(key=zlib.crc32)
    bad = _trained([b"".join(x) for x in parts if x], max(DICTIONARY, sum(map(len, chosen))))
    bad = b"".join(x for x in chosen if x not in bad) + bad
    passages = passages[:PASSAGES]
    size = max(DICTIONARY, len(bad))
    good = _trained(passages, size) or b"".join(passages)[-size:]
    usual = Counter(chain.from_iterable(map(set, ordinary.words)))
    often = sorted((w for w, n in usual.items() if n >= max(LEAST, USUAL * len(ordinary.words)) and SPACES + w + SPACES not in count), key=lambda w: (usual[w], w))
    good = SPACES.join([b"", *(w for w in often if SPACES + w + SPACES not in good), good])
    return bad, good, int(np.median(lengths([x[2:-2] for x in chosen], Model(bad, good, 0, ()))[1]))


def _trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of the samples, empty if they are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b""


def fit(docs: DataFrame, labels: DataFrame, admitted: Column, docs_per_class: int = DOCS_PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from labelled documents whose doc_id ``admitted`` admits. The sample is bounded and repeatable: of each
    class the ids with the smallest hashes, found among the labels alone; their list is broadcast to find the texts."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(admitted).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = unit_hash(F.col("doc_id"), "toxicity sample")
    limit = F.when(F.col("toxic") == 1, docs_per_class / max(1, sizes.get(1, 0))).otherwise(docs_per_class / max(1, sizes.get(0, 0)))
    wanted = known.where(share < limit).select("doc_id", "toxic", share.alias("order"))
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    by_class = [[words_of(r["text"].encode()) for r in bounded_rows(sample.where(F.col("toxic") == c), "order", sample_chars) if r["text"]] for c in (0, 1)]
    return learn(by_class[1], by_class[0], sizes)


def learn(toxic: list[list[bytes]], ordinary: list[list[bytes]], sizes: dict[int, int]) -> Model:
    """The model of documents given as words; sizes: how many documents each class has among all labels."""
    ordinary, toxic = _once(ordinary), _once(toxic)
    if not ordinary or not toxic:
        return Model(b"", b"", 0, (0.0,) * (2 * CLASSES + 1 + len(RUN_GAINS)) + (-20.0,))
    some = samples(toxic, ordinary)
    # each third of the documents is measured with the dictionaries of the others; of two documents of a class each is
    # held out once, and only a single one has to do both
    folds = min(3, len(toxic), len(ordinary))
    x, y = [], []
    for f in range(folds):
        draft = Model(*dictionaries(*(part.some(lambda i, f=f: folds == 1 or i % folds != f) for part in some)), ())
        known = Recent(REMEMBERED)
        for c, part in ((1, some[0]), (0, some[1])):
            held = part.words[f::folds][: CALIBRATED // folds]
            x += _measured(held, draft, known)
            y += [c] * len(held)
    x, y = np.array(x), np.array(y)
    real = {1: sizes[1] / (sizes[0] + sizes[1]), 0: sizes[0] / (sizes[0] + sizes[1])}
    weight = np.array([real[c] * len(y) / max(1, (y == c).sum()) for c in y])
    w = logistic(x, y, weight)
    z = x @ w[:-1] + w[-1]
    # the threshold with the fewest errors becomes score 0.5
    order = np.argsort(-z, kind="stable")
    errors = np.cumsum(np.where(y[order] == 1, -weight[order], weight[order]))
    ends = np.flatnonzero(np.append(z[order][1:] != z[order][:-1], True))
    best = ends[np.argmin(errors[ends])]
    if errors[best] < 0:
        after = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
        w[-1] -= (z[order][best] + after) / 2
    return Model(*dictionaries(*some), tuple(w.tolist()))


def _measured(parts: list[list[bytes]], model: Model, known: Recent) -> list[list[float]]:
    """The measures of some documents, given as words."""
    own = [set(p) for p in parts]  # a repeated word counts once
    missing = known.missing(set().union(*own))
    known.young.update(zip(missing, classes(*lengths(missing, model), model.whole).tolist(), strict=True))
    get = known.young.__getitem__
    runs = [runs_of(p) for p in parts]
    # most of a run's words are ordinary ones, which here both dictionaries hold
    ordinary, toxic = lengths(list(chain.from_iterable(runs)), replace(model, toxic=model.ordinary + model.toxic if model.toxic else b""))
    gain = (ordinary - toxic).tolist()
    ends = np.cumsum([0, *map(len, runs)]).tolist()
    return [measures([*map(get, p)], gain[a:b]) for p, a, b in zip(own, ends, ends[1:], strict=False)]


_known: dict[int, Recent] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_toxic (words that lie in the toxic dictionary and gain), n_windows of every whole text. The
    model is two dictionaries of 16 KB or as long as the chosen parts need."""
    ship(docs.sparkSession)
    key = zlib.crc32(model.toxic + b"|" + model.ordinary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _known:
            _known.clear()
            _known[key] = Recent(REMEMBERED)
        known, weights = _known[key], np.array(model.weights)
        for batch in batches:
            found, ids = texts(batch), column(batch, "doc_id")
            for a, b in slices([len(t or b"") for t in found], AT_ONCE):
                parts = [words_of(t) for t in found[a:b]]
                x = np.array(_measured(parts, model, known))
                n_toxic = np.rint(np.expm1(x[:, 0])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sigmoid(x @ weights[:-1] + weights[-1])), pa.array(n_toxic), pa.array([len(p) + len(runs_of(p)) for p in parts], pa.int64())],
                    ["doc_id", "score", "n_toxic", "n_windows"],
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, score double, n_toxic bigint, n_windows bigint")
