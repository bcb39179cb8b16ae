"""Page layout of MusicXML scores as a table function: measures with their page, system, meter, key, words, barlines and
the durations of their voices.

The function takes a table of documents, partitioned by piece and ordered by document, so that pages and measures of a
document go on where the one before ended. ``register`` makes it callable from SQL:

    SELECT * FROM layout_scan(TABLE(documents) PARTITION BY piece ORDER BY document)
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from scorelake.operators import ordered
from scorelake.operators.cluster import ship

SCAN = """piece string, document bigint, measure int, xml_number string, page int, system int, x double, y double, w double, meter string, key string, changed boolean,
 words array<string>, notes int, quarters double, expected double, middle_barline boolean, final_barline boolean, valid boolean"""

# A page without a size of its own, the share of its width that margins take, the distances of systems from
# the top and from one another; the least width of a system; shortest bar in quarters, least share of its expected length.
PAGE, MARGIN, TOP, BETWEEN, NARROWEST = (1500.0, 2000.0), 0.08, 180.0, 140.0, 0.05
SHORTEST, SHARE = 0.0625, 0.25
# How much of the room down to the next system a system is high, with its least and greatest height, and
# where the last system's room ends.
HEIGHT, LOWEST, HIGHEST, BOTTOM = 0.72, 0.035, 0.14, 0.96
# Words that name a movement.
TITLES = ("adagio", "fuga", "fugue", "siciliana", "presto", "allegro", "andante", "largo")
# The major key of each number of sharps, flats below zero.
KEYS = {-7: "Cb", -6: "Gb", -5: "Db", -4: "Ab", -3: "Eb", -2: "Bb", -1: "F", 0: "C", 1: "G", 2: "D", 3: "A", 4: "E", 5: "B", 6: "F#", 7: "C#"}


def _read(content: bytes | str) -> tuple[ElementTree.Element, str]:
    """A document and what its tags begin with: its name space, if all are of one. Others lose theirs."""
    root = ElementTree.fromstring(content)
    space = root.tag[: root.tag.find("}") + 1]
    if any(not tag.startswith(space) or "}" in tag[len(space) :] for tag in {node.tag for node in root.iter()}):
        for node in root.iter():
            node.tag = node.tag.rsplit("}", 1)[-1]
        space = ""
    return root, space


def _number(text: str | None, default: float) -> float:
    """The number that a text says; the default if there is none."""
    try:
        return float(text)
    except (TypeError, ValueError):
        return default


def _key(fifths: str | None) -> str | None:
    if fifths is None or not fifths.strip():
        return None
    try:
        return KEYS.get(int(fifths), f"{fifths.strip()} fifths")
    except ValueError:
        return fifths.strip()


class _Names:
    """Tags with the name space of their document before them."""

    def __init__(self, space: str):
        for name in ("part", "measure", "defaults", "page-layout", "page-width", "page-height", "print", "system-layout", "system-margins", "left-margin", "right-margin", "top-system-distance",
                     "system-distance", "attributes", "divisions", "time", "beats", "beat-type", "key", "fifths", "barline", "bar-style", "words", "note", "forward", "backup", "grace", "pitch", "rest",
                     "chord", "voice", "duration"):
            setattr(self, name.replace("-", "_"), space + name)


_names = lru_cache(maxsize=64)(_Names)


def voices(measure: ElementTree.Element, divisions: float, n: _Names = _Names("")) -> tuple[int, dict[str, float]]:
    """The pitched notes of a measure (grace notes aside) and the quarters that each voice lasts. Notes of a chord and
    grace notes take no time of their own; a forward moves the voice that wrote last, and a backup goes to voice 1."""
    count, lasts, voice, divisions = 0, {}, "1", max(divisions, 1.0)
    note, forward, backup = n.note, n.forward, n.backup
    for node in measure:
        tag = node.tag
        if tag == note or tag == forward:
            own: dict[str, str | None] = {}
            for x in node:  # of several of a name the first counts
                own.setdefault(x.tag, x.text)
            plain = n.grace not in own
            if tag == note:
                voice = (own.get(n.voice) or "").strip() or voice
                count += plain and n.pitch in own and n.rest not in own
            if plain and n.chord not in own:
                lasts[voice] = lasts.get(voice, 0.0) + _number(own.get(n.duration), 0.0) / divisions
        elif tag == backup:
            voice = "1"
    return count, lasts


def _first(*levels: str, within: ElementTree.Element) -> str | None:
    """The text of the first element at two levels of tags."""
    for node in within:
        if node.tag == levels[0]:
            for x in node:
                if x.tag == levels[1]:
                    return x.text or ""
    return None


def _signs(measure: ElementTree.Element, n: _Names) -> list[str | None] | None:
    """The first divisions, beats, beat type and fifths that the attributes of a measure state; nothing if it has none."""
    said: list[str | None] | None = None
    for node in measure:
        if node.tag == n.attributes:
            said = said or [None] * 4
            for x in node:
                if x.tag == n.divisions:
                    said[0] = x.text or "" if said[0] is None else said[0]
                elif x.tag == n.time:
                    for y in x:
                        if y.tag == n.beats:
                            said[1] = y.text or "" if said[1] is None else said[1]
                        elif y.tag == n.beat_type:
                            said[2] = y.text or "" if said[2] is None else said[2]
                elif x.tag == n.key and said[3] is None:
                    said[3] = x.findtext(n.fifths)
    return said


def document_rows(content: bytes | str) -> Iterator[tuple]:
    """The measures of a document's first part, pages and measures counted from 1: all of SCAN behind ``document``. A
    document that is no XML or has no part gives none."""
    try:
        root, space = _read(content)
    except ElementTree.ParseError:
        return
    n = _names(space)
    part = next((x for x in root.iter(n.part) if x is not root), None)
    if part is None:
        return
    size = f"{n.defaults}/{n.page_layout}/"
    width = max(1.0, _number(root.findtext(size + n.page_width), PAGE[0]))
    height = max(1.0, _number(root.findtext(size + n.page_height), PAGE[1]))
    page, system, divisions, meter, key, expected = 1, 0, 1.0, None, None, None
    x = y = w = 0.0
    for number, measure in enumerate(part.findall(n.measure), 1):
        mark = measure.find(n.print)
        turns = mark is not None and mark.get("new-page") == "yes"
        if turns and number > 1:
            page, system, y = page + 1, 0, 0.0
        if system == 0 or turns or (mark is not None and mark.get("new-system") == "yes"):
            system += 1
            place = mark.find(n.system_layout) if mark is not None else None
            left = right = width * MARGIN
            if place is not None:
                y = _number(place.findtext(n.top_system_distance), TOP) / height if system == 1 else y + _number(place.findtext(n.system_distance), BETWEEN) / height
                left, right = (_number(_first(n.system_margins, side, within=place), width * MARGIN) for side in (n.left_margin, n.right_margin))
            x, w = left / width, max(NARROWEST, (width - left - right) / width)
        changed = False
        if said := _signs(measure, n):
            divisions = _number(said[0], divisions)
            new_meter, new_key = f"{said[1].strip()}/{said[2].strip()}" if said[1] and said[2] else None, _key(said[3])
            changed = (new_meter is not None and new_meter != meter) or (new_key is not None and new_key != key)
            key = new_key or key
            if new_meter:
                meter = new_meter
                try:
                    over = meter.split("/")
                    expected = float(over[0]) * 4 / float(over[1])
                except (ValueError, ZeroDivisionError):
                    expected = None
        count, lasts = voices(measure, divisions, n)
        quarters = max(lasts.values(), default=0.0)
        middle = final = False
        for bar in measure.iter(n.barline):
            side = (bar.get("location") or "").lower()
            middle = middle or side == "middle"
            final = final or (side == "right" and (bar.findtext(n.bar_style) or "").strip().lower() in ("light-heavy", "heavy"))
        wanted = expected if expected is not None else quarters or 1.0
        valid = count > 0 and not middle and quarters >= max(SHORTEST, wanted * SHARE)
        words = [t.strip() for t in (e.text for e in measure.iter(n.words)) if t and t.strip()]
        yield number, measure.get("number"), page, system, x, y, w, meter, key, changed, words, count, quarters, expected, middle, final, valid


@udtf(returnType=SCAN)
class LayoutScan:
    """One instance per piece: it remembers how many pages and measures the documents before had."""

    def __init__(self):
        self.pages = self.measures = 0

    def eval(self, document: Row):
        pages = measures = 0
        for number, name, page, *rest in document_rows(document["content"] or ""):
            pages, measures = max(pages, page), number
            yield str(document["piece"]), document["document"], number + self.measures, name, page + self.pages, *rest
        self.pages += pages
        self.measures += measures


def register(spark: SparkSession) -> None:
    """Make ``layout_scan`` known to SQL."""
    ship(spark)
    spark.udtf.register("layout_scan", LayoutScan)


#: Documents that are read at a time.
AT_ONCE = 1_024
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: SCAN with pages and measures counted from 1 in each document, how many pages that has, and a number of its own.
_PARSED = [tuple(c.split()) for c in (SCAN.replace("\n", "") + ", _pages bigint, _at bigint").split(", ")]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in _PARSED])
    context = TaskContext.get()
    at = context.partitionId() << 40 if context else 0
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(k, AT_ONCE)
            rows: list[tuple] = []
            sizes, pages = [], []
            gc.disable()  # elements have no cycles, and looking for some costs a third of the time
            for content in some.column("content").to_pylist():
                own = list(document_rows(content or ""))
                sizes.append(len(own))
                pages.append(own[-1][2] if own else 0)
                rows += own
            gc.enable()
            if rows:
                document = np.repeat(np.arange(len(sizes)), sizes)
                found = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), schema.types[2:-2], strict=True)]
                ends = [pa.array(np.array(pages, np.int64)[document]), pa.array(document + at)]
                yield pa.RecordBatch.from_arrays([some.column(name).take(pa.array(document)) for name in ("piece", "document")] + found + ends, schema=schema)
            at += len(sizes)


def scan(documents: DataFrame) -> DataFrame:
    """The measures of ``documents`` (piece, document, content) as the table function gives them, but documents are read where
    they are and by themselves: only the measures found are brought together by piece, where pages and measures go on from
    one document to the next."""
    ship(documents.sparkSession)
    rows = documents.select(F.col("piece").cast("string").alias("piece"), F.col("document").cast("bigint").alias("document"), "content")
    found = rows.mapInArrow(_parsed, ", ".join(" ".join(c) for c in _PARSED))
    upto = W.partitionBy("piece").orderBy("document", "_at", "measure").rowsBetween(W.unboundedPreceding, W.currentRow)
    # the first measure of a document brings all of its pages
    pages = F.sum(F.when(F.col("measure") == 1, F.col("_pages")).otherwise(0)).over(upto) - F.col("_pages")
    placed = found.withColumn("page", (F.col("page") + pages).cast("int")).withColumn("measure", F.row_number().over(W.partitionBy("piece").orderBy("document", "_at", "measure")))
    return placed.drop("_pages", "_at")


def systems(measures: DataFrame) -> DataFrame:
    """piece, page, system, x, y, w, h, first, last, n: systems as boxes, as high as the next system of the page lets
    them be."""
    keys = ["piece", "page", "system"]
    found = measures.groupBy(*keys).agg(*(F.min(c).alias(c) for c in ("x", "y", "w")), F.min("measure").alias("first"), F.max("measure").alias("last"), F.count("*").alias("n"))
    below = F.coalesce(F.lead("y").over(W.partitionBy("piece", "page").orderBy("system")), F.lit(BOTTOM))
    return found.withColumn("h", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), (below - F.col("y")) * HEIGHT)))


def _titles(words: str) -> Column:
    return F.filter(words, lambda w: F.lower(w).rlike("|".join(TITLES)))


def movements(measures: DataFrame) -> DataFrame:
    """piece, measure, movement, bar, title of the valid measures. A movement begins where a word names one, where meter or
    key change, and after a final barline; its title is that word, or its number. Three movements need no repair by a
    final barline without a new meter here, since every final barline ends one."""
    valid = measures.where("valid")
    order = W.partitionBy("piece").orderBy("measure")
    ended = F.coalesce(F.lag("final_barline").over(order), F.lit(True))
    rows = valid.withColumn("_begins", ended | F.col("changed") | (F.size(_titles("words")) > 0))
    rows = ordered.running_starts(rows, ["piece"], ["measure"], F.col("_begins"), "movement")
    within = W.partitionBy("piece", "movement").orderBy("measure")
    title = F.coalesce(F.get(F.first(_titles("words")).over(within), 0), F.concat(F.lit("Movement "), F.col("movement").cast("string")))
    return rows.select("piece", "measure", "movement", F.row_number().over(within).cast("bigint").alias("bar"), title.alias("title"))
