"""Language proportions of each document by expectation-maximisation over n-gram likelihoods.

``fit`` learns, from a sample of the labelled documents of each language, how likely each byte trigram of a lower-case
word is in it. The sample's trigrams are counted where the texts lie, so no language is cut for another's sake. A document is a bag of words drawn from a mixture of languages: a word's likelihood in a language is the
product over its trigrams, and EM finds the proportions. The set of languages starts with the best single one and grows
in the order of the proportions under all languages, as long as the log-likelihood rises by more than ``penalty`` times
the log of the number of words. All documents of a batch go through EM together.

Defined cases: a null text and a text without a letter are ``und`` with score 0; a text whose letters are all unseen gets
the language that the smoothed likelihoods favour; with no labelled document at all every text is ``und``; ties go
to the first language in code-point order; repeated rows and null ids are kept as rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Recent, column, ship, slices, texts, unit_hash

BUCKETS = 1 << 16
#: The training sample: documents of a language, whatever their length.
DOCS_PER_LANGUAGE = 1_500
#: Languages that are learned, those with the most labelled documents: a row of counts each at the driver and, half as
#: large, in every task (130 MB for all of them).
MOST_LANGUAGES = 500
#: Bytes of the longest word that stays whole, and of the pieces of longer ones.
LONGEST, PIECE = 36, 12
#: Languages whose counts a task holds at once.
HELD = 64
AT_ONCE, REMEMBERED = 2 << 20, 150_000


@dataclass(frozen=True)
class Profiles:
    """log_p[l, b]: log-probability of trigram bucket b in language l."""

    languages: tuple[str, ...]
    log_p: np.ndarray
    penalty: float = 3.0


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of the words between boundary spaces, and the words' end offsets in that list."""
    joined = b"".join(b" " + w + b" " for w in words)
    flat = np.frombuffer(joined, np.uint8).astype(np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 2)
    bucket = np.zeros(len(flat), np.uint32)
    if len(flat) > 2:
        bucket[:-2] = (flat[:-2] * np.uint32(0x9E3779B1) ^ flat[1:-1] * np.uint32(0x85EBCA6B) ^ flat[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    # a word of n bytes has n trigrams; the two positions at its end are not trigrams of it
    keep = np.ones(len(flat), bool)
    keep[ends - 1] = keep[ends - 2] = False
    return bucket[keep], np.cumsum(n)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words that have a letter. Long ones, as all text of a script that puts no spaces between words, come in
    pieces that share two bytes, so that no trigram is lost and a document's weight goes by its length."""
    if not text:
        return []
    lower = text.decode(errors="replace").lower()
    if lower.isascii():
        words = [w for w in lower.encode().split() if not w.isdigit() and any(97 <= c <= 122 for c in w)]
    else:
        words = [w.encode() for w in lower.split() if any(map(str.isalpha, w))]
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [x for w in words for x in ([w] if len(w) <= LONGEST else [w[i : i + PIECE] for i in range(0, len(w) - 2, PIECE - 2)])]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each language's trigrams by bucket, added up over batches; a language without a word has the row (lang, 0, 0)."""
    seen: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in seen.items():
            at = np.flatnonzero(n) if n.any() else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
        seen.clear()

    for batch in batches:
        for lang, text in zip(column(batch, "lang").to_pylist(), texts(batch), strict=True):
            if lang not in seen and len(seen) == HELD:
                yield from rows()
            into = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
            words = words_of(text)
            for a, b in slices(list(map(len, words)), AT_ONCE):
                into += np.bincount(trigrams(words[a:b])[0], minlength=BUCKETS)
    yield from rows()


def fit(docs: DataFrame, labelled: Column, docs_per_language: int = DOCS_PER_LANGUAGE) -> Profiles:
    """Learn from documents that ``labelled`` admits. The sample is repeatable: of each language the documents with the
    smallest hashes of their id, all of them if they are ``docs_per_language`` at most. Their list is broadcast to find
    the texts, which are not shuffled; only counts by language and bucket are."""
    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(labelled & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = F.broadcast(ids.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES))
    wanted = ids.join(counts, "lang").where(unit_hash(F.col("doc_id"), "language sample") * F.col("count") < docs_per_language).select("doc_id", "lang").distinct()
    texts_ = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sample = texts_.join(F.broadcast(wanted), ["doc_id", "lang"]).select("lang", "text")
    summed = sample.mapInArrow(_counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    langs = found.column("lang").to_numpy() if found.num_rows else np.array([])
    languages = tuple(sorted(set(langs.tolist())))
    seen = np.zeros((len(languages), BUCKETS), np.float32)
    if languages:
        row = {x: i for i, x in enumerate(languages)}
        seen[[row[x] for x in langs.tolist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    smooth = 0.5
    log_p = np.log((seen + np.float32(smooth)) / (seen.sum(1, keepdims=True, dtype=np.float64) + smooth * BUCKETS).astype(np.float32))
    return Profiles(languages, log_p)


def word_scores(words: list[bytes], profiles: Profiles) -> np.ndarray:
    """Log-likelihood of each word in each language, up to the same constant for all languages."""
    if not words:
        return np.zeros((0, len(profiles.languages)))
    bucket, ends = trigrams(words)
    total = np.concatenate([np.zeros((1, len(profiles.languages))), np.cumsum(profiles.log_p[:, bucket].T, axis=0, dtype=np.float64)])
    scores = total[ends] - total[np.concatenate([[0], ends[:-1]])]
    return scores - scores.max(1, keepdims=True)


def em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, mask: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document over the languages that ``mask`` allows it. like: a row for each
    word; doc: its document; first: each document's first word. Every document has a word at least."""
    n = np.diff(np.append(first, len(doc)))[:, None]
    p = mask / mask.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = like * p[doc]
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        p = np.add.reduceat(joint, first, axis=0) / n
    fit_ = np.add.reduceat(np.log(np.maximum((like * p[doc]).sum(1), 1e-300)), first)
    return p, fit_


def mixtures(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions (document x language) of the penalised-likelihood language sets; lengths: words per document, 1 at
    least."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    like = np.exp(np.maximum(scores, -60))
    every = np.ones((len(lengths), scores.shape[1]))
    order = np.argsort(-em(like, doc, first, every, 6)[0], axis=1, kind="stable")
    single = np.add.reduceat(np.maximum(scores, -60), first, axis=0)
    best = single.argmax(1)
    order = np.array([[b, *(o for o in row if o != b)] for b, row in zip(best.tolist(), order.tolist(), strict=True)])
    out = np.zeros_like(every)
    out[np.arange(len(best)), best] = 1
    reached = single[np.arange(len(best)), best]
    cost = penalty * np.log(np.maximum(lengths, 2))
    live = np.arange(len(best))
    for k in range(2, scores.shape[1] + 1):
        mask = np.zeros((len(live), scores.shape[1]))
        np.put_along_axis(mask, order[live, :k], 1, 1)
        # no mixture of the set beats every word in its best language: documents that even this doesn't help stop here
        words = np.isin(doc, live)
        local = np.repeat(np.arange(len(live)), lengths[live])
        starts = np.concatenate([[0], np.cumsum(lengths[live])[:-1]])
        bound = np.add.reduceat(np.where(mask[local] > 0, np.maximum(scores[words], -60), -np.inf).max(1), starts)
        may = bound - reached[live] > cost[live]
        live, mask = live[may], mask[may]
        if not len(live):
            break
        words = np.isin(doc, live)
        local = np.repeat(np.arange(len(live)), lengths[live])
        starts = np.concatenate([[0], np.cumsum(lengths[live])[:-1]])
        p, value = em(like[words], local, starts, mask, 12)
        better = value - reached[live] > cost[live]
        out[live[better]], reached[live[better]] = p[better], value[better]
        live = live[better]
        if not len(live):
            break
    return out


_known: dict[str, Recent] = {}


def infer(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of that language), and proportions (language -> share) of every
    whole text. The profiles (buckets x languages numbers) are broadcast."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(profiles)
    key = f"{hash(profiles.log_p.tobytes())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if key not in _known:
            _known.clear()
            _known[key] = Recent(REMEMBERED)
        known = _known[key]
        for batch in batches:
            found, ids = texts(batch), column(batch, "doc_id")
            for a, b in slices([len(t or b"") for t in found], AT_ONCE):
                words = [words_of(t) if model.languages else [] for t in found[a:b]]
                missing = known.missing(set(chain.from_iterable(words)))
                known.young.update(zip(missing, map(np.ndarray.tobytes, word_scores(missing, model).astype(np.float32)), strict=True))
                get = known.young.__getitem__
                some = [i for i, w in enumerate(words) if w]
                preds, scores, shares = ["und"] * (b - a), [0.0] * (b - a), [[] for _ in range(b - a)]
                if some:
                    lengths = np.array([len(words[i]) for i in some])
                    flat = np.frombuffer(b"".join(get(w) for i in some for w in words[i]), np.float32).reshape(-1, len(model.languages))
                    for i, row in zip(some, mixtures(flat, lengths, model.penalty), strict=True):
                        k = int(row.argmax())
                        preds[i], scores[i] = model.languages[k], min(1.0, float(row[k]))
                        shares[i] = [(model.languages[j], float(row[j])) for j in np.flatnonzero(row > 0)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "lang_pred", "score", "proportions"],
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, lang_pred string, score double, proportions map<string,double>")
