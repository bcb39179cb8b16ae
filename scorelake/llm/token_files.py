"""Files of token ids: documents in ascending doc_id order, coded in sections (see rans.py).

``write`` deals the documents out by ranges of doc_id, so file k holds smaller ids than file k + 1, encodes each range
in one task, and stores rows of (file, section, doc_ids, lengths, symbols, freqs, blocks) with Spark's writer, whose
commit makes a lost or repeated task harmless. A section holds whole documents of about a million tokens, so memory
does not follow the size of a file. ``read`` decodes the sections in parallel; where a document starts in the whole
sequence comes from sums over files, then over groups of files.

Defined cases: a null text is an empty one and has only the end id; null ids come first; rows that share an id are
kept, in the order of a hash of their text, and such a group may lie in several files; an empty table gives no files'
rows and an empty result; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.llm import rans
from scorelake.llm.chunks import AT_ONCE, LONGEST, ChunkEncoder
from scorelake.llm.common import Recent, column, ship, slices, texts

SECTION_TOKENS = 1 << 20
#: Pieces of letters whose ids a worker remembers, and their greatest length: one piece has many parts by the stop behind it.
PIECES, PIECE_LENGTH = 200_000, 40
FILE = "file int, section int, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, symbols binary, freqs binary, blocks array<binary>"
_FILE = pa.schema(
    [("file", pa.int32()), ("section", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("symbols", pa.binary()), ("freqs", pa.binary()), ("blocks", pa.list_(pa.binary()))]
)

_workers: dict[str, ChunkEncoder] = {}


#: The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow 255.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b if b in _PRINTABLE else 256 + sum(o not in _PRINTABLE for o in range(b)) for b in range(256)}


_SPACE = chr(_BYTES[32])
#: The first character outside of Latin.
BEYOND = "\u0250"
#: What the tokenizers' pattern says of ASCII text.
_ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def _encoder(path: str) -> ChunkEncoder:
    """This worker's encoder. The library's model gets the pieces of a part themselves: of a space with letters, and with
    one stop after them, they are known; of other parts in characters below BEYOND, of whose classes all versions of
    Unicode agree, the pattern finds them. Parts with other characters or with an added token, and whole texts, go
    through the whole library."""
    if path not in _workers:
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        merge = tokenizer.model.tokenize
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        of_ascii, of_latin = re.compile(_ASCII_PATTERN, re.ASCII).findall, regex.compile(public_tokenizers.PATTERN).findall
        stops = {c: array("I", [t.id for t in merge(c)]).tobytes() for c in ".,;:!?"}

        known = Recent(PIECES)

        def letters(part: str) -> bytes:
            found = known.young.get(part) or known.old.get(part)
            if found is None:
                written = part.replace(" ", _SPACE) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_BYTES)
                found = array("I", [t.id for t in merge(written)]).tobytes()
            if len(part) <= PIECE_LENGTH:
                known.young[part] = found
            return found

        def encode(parts: list[str]) -> list[bytes]:
            known.turn()
            out: list[bytes | None] = []
            rest = []
            for part in parts:
                if part[:1] == " " and part[1:].isalpha():
                    out.append(letters(part))
                elif part[:1] == " " and part[-1] in stops and part[1:-1].isalpha():
                    out.append(letters(part[:-1]) + stops[part[-1]])
                elif len(part) <= LONGEST and max(part) < BEYOND and not any(t in part for t in added):
                    out.append(b"".join(map(letters, (of_ascii if part.isascii() else of_latin)(part))))
                else:
                    out.append(None)
                    rest.append(part)
            found = iter(tokenizer.encode_batch_fast(rest, add_special_tokens=False))
            return [array("I", next(found).ids).tobytes() if x is None else x for x in out]

        _workers[path] = ChunkEncoder(encode, at_once=2 * AT_ONCE)
    return _workers[path]


def _section(file: int, number: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    tokens = np.frombuffer(b"".join(ids), "<u4")
    symbols, freqs = rans.frequencies(tokens)
    row = {"file": file, "section": number, "n_tokens": len(tokens), "doc_ids": doc_ids, "lengths": [len(x) // 4 for x in ids]}
    row |= {"symbols": symbols.astype("<u4").tobytes(), "freqs": freqs.astype("<u4").tobytes(), "blocks": rans.encode(tokens, symbols, freqs)}
    return pa.RecordBatch.from_pylist([row], schema=_FILE)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every whole text, append ``end_id``, and store the ids under ``path``."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, number, held = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        ids: list[bytes] = []
        for batch in batches:
            found, names = [t or b"" for t in texts(batch)], column(batch, "doc_id").to_pylist()
            for a, b in slices([len(t) for t in found], 2 << 20):
                for name, x in zip(names[a:b], encoder(found[a:b]), strict=True):
                    doc_ids.append(name)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= SECTION_TOKENS:
                        yield _section(file, number, doc_ids, ids)
                        doc_ids, ids, held, number = [], [], 0, number + 1
        if ids:
            yield _section(file, number, doc_ids, ids)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ordered.mapInArrow(run, FILE).write.parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """file, section, start: the tokens before each section. Sums go up from sections to files to groups of 4,096
    files and down again, so no task sees more than that many rows of one level."""
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sections = files.select("file", "section", "n_tokens").withColumn("s", before("n_tokens", W.partitionBy("file").orderBy("section")))
    by_file = sections.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("g", F.floor(F.col("file") / 4096))
    in_group = by_file.withColumn("f", before("n", W.partitionBy("g").orderBy("file")))
    groups = by_file.groupBy("g").agg(F.sum("n").alias("n")).withColumn("b", before("n", W.orderBy("g"))).select("g", "b")
    base = in_group.join(groups, "g").select("file", (F.col("f") + F.col("b")).alias("base"))
    return sections.join(base, "file").select("file", "section", (F.col("base") + F.col("s")).alias("start"))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary) of every document in the files. Sections are
    decoded where they are read; only a few numbers per document meet the sections' starts."""
    ship(spark)
    files = spark.read.schema(FILE).parquet(path)
    names = ["file", "section", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lengths = np.array(row["lengths"], np.int64)
                tokens = rans.decode(row["blocks"], np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["freqs"], "<u4"))
                raw, ends = tokens.astype("<u4").tobytes(), np.cumsum(lengths)
                own = [raw[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(np.full(len(own), row[k], np.int32)) for k in ("file", "section")]
                cols += [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(own, pa.binary())] * with_ids], names)

    schema = "file int, section int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    found = files.select("file", "section", "doc_ids", "lengths", "symbols", "freqs", "blocks").mapInArrow(run, schema)
    return found.join(starts(files), ["file", "section"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), *names[4:])
