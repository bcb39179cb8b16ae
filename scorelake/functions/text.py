"""Text as column expressions: ids, capping, JSON in fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields that an answer has.
ANSWER_FIELDS = ("lesson", "comments", "progress_notes")


def without_octave(name: Column) -> Column:
    """A trailing number, with its sign, removed."""
    return F.regexp_replace(name, "[0-9-]+$", "")


def safe_id(text: Column, prefix: str = "cmt_", most: int = 64) -> Column:
    """Characters that are unsafe in a path become underscores."""
    return F.concat(F.lit(prefix), F.substring(F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_"), 1, most))


def capped(text: Column, most: int, head: int, tail: int) -> Column:
    """A long text as its head and its tail."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(tail)))).otherwise(text)


def fenced_json(text: Column) -> Column:
    """The object inside a json fence, empty if there is none."""
    return F.regexp_extract(text, r"```json *(\{[^`]*\}) *```", 1)


def balanced_object(text: Column) -> Column:
    """From the first opening brace to the one that closes it, braces inside strings not counted; null if none does."""
    rest = F.substring(text, F.nullif(F.instr(text, "{"), F.lit(0)), F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.when(s["done"], s).otherwise(
            F.struct(
                depth.alias("depth"), (s["quoted"] != quote).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
                (s["n"] + 1).alias("n"), ((depth == 0) & (c == "}") & ~s["quoted"]).alias("done"),
            )
        )

    end = F.aggregate(F.split(rest, ""), start, step)
    return F.when(end["done"], F.substring(rest, F.lit(1), end["n"]))


def json_block(text: Column) -> Column:
    """The JSON object of an answer: what a fence for JSON holds, else what any fence holds, else the first balanced
    object; what does not parse is passed over, and null is left if nothing does."""
    found = [F.regexp_extract(text, rf"(?s)```{kind}\s*(\{{.*?\}})\s*```", 1) for kind in ("json", "")]
    return F.coalesce(*(F.when(F.try_parse_json(x).isNotNull() & (x != ""), x) for x in (*found, balanced_object(text))))


def response_error(body: Column) -> Column:
    """What is wrong with an answer's JSON, null if nothing is."""
    value = F.try_parse_json(body)
    kind = lambda v: F.schema_of_variant(v)
    field = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
    missing = F.array_except(F.array(*map(F.lit, ANSWER_FIELDS)), F.json_object_keys(body))
    bare = lambda c: kind(c).startswith("OBJECT") & ~F.arrays_overlap(F.json_object_keys(F.to_json(c)), F.array(F.lit("references"), F.lit("note_refs")))
    first = F.array_position(F.transform(F.try_variant_get(value, "$.comments", "array<variant>"), bare), F.lit(True))
    return (
        F.when(missing.isNull(), "not an object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")))
        .when(~F.coalesce(kind(field("lesson")).startswith("OBJECT"), F.lit(False)), "field lesson must be an object")
        .when(~F.coalesce(kind(field("comments")).startswith("ARRAY"), F.lit(False)), "field comments must be a list")
        .when(first > 0, F.concat(F.lit("comment "), first.cast("string"), F.lit(" missing references")))
    )


def clip(name: Column) -> Column:
    """start_sec, end_sec and height in the name of a clip, null for other names."""
    part = lambda i: F.regexp_extract(name, r"^clip_(\d+)_(\d+)_h(\d+)\.mp4$", i)
    found = F.struct((part(1).try_cast("bigint") / 1000.0).alias("start_sec"), (part(2).try_cast("bigint") / 1000.0).alias("end_sec"), part(3).try_cast("bigint").alias("height"))
    return F.when(part(1) != "", found)


def log_record(time: Column, level: Column, logger: Column, message: Column, context: dict[str, Column], extra: dict[str, Column]) -> Column:
    """A log line: fixed fields, then the context that is there, then further fields."""
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fields = {"ts": stamp, "level": level, "logger": logger, "msg": message} | context | extra
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def comment_thread(comment_id: Column, most: int = 64) -> Column:
    """The id of a comment's thread; null for an empty comment id, which has none."""
    bare = F.trim(F.coalesce(comment_id, F.lit("")))
    return F.when(bare != "", safe_id(bare, "cmt_", most))


def path_safe(name: Column) -> Column:
    """A name that may stand in a path, trimmed: letters, digits, underscore, dot and dash, no two dots in a row; null for
    any other."""
    bare = F.trim(name)
    return F.when(bare.rlike(r"^[A-Za-z0-9_.-]+$") & ~bare.contains(".."), bare)


def movement_number(url: Column) -> Column:
    """The number in the file name of a movement, ``..._3.mid`` or ``.midi`` in any case, behind which a query, a fragment or
    slashes may stand; null for other names."""
    bare = F.rtrim(F.substring_index(F.substring_index(url, "?", 1), "#", 1), F.lit("/\\"))
    name = F.lower(F.element_at(F.split(bare, r"[/\\]"), -1))
    return F.regexp_extract(name, r"_(\d+)\.midi?$", 1).try_cast("int")


#: A comment as an answer may hold it, with the older names of fields; what is of another kind is taken for missing.
COMMENT = (
    "struct<id: string, start: double, start_sec: double, end: double, end_sec: double, measure: int, beat: double, category: string, severity: string, "
    "summary: string, title: string, text: string, message: string, confidence: string>"
)


def objects(value: Column, schema: str) -> Column:
    """The elements of a variant that is an array, read by ``schema``; null stands for those that are no objects, and for
    the whole if it is no array."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    return F.transform(listed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.from_json(F.to_json(v), schema)))


def comments(body: Column) -> Column:
    """The comments of a JSON array in their normal form, by their start: defaults where a field is missing or empty, a new
    name before an old one, no time below zero, no end before its start. What is no object is left out, but counted for the
    ids of those without one."""
    given = objects(F.try_parse_json(body), COMMENT)
    said = lambda *names: F.coalesce(*(F.nullif(n, F.lit("")) for n in names))

    def normal(c: Column, i: Column) -> Column:
        start = F.coalesce(c["start"], c["start_sec"], F.lit(0.0))
        late = F.greatest(start + 2.0, start)
        end = F.coalesce(F.nullif(F.coalesce(c["end"], c["end_sec"]), F.lit(0.0)), late)
        return F.struct(
            F.round(F.greatest(F.lit(0.0), start), 3).alias("start"), F.coalesce(said(c["id"]), F.format_string("g_%03d", i + 1)).alias("id"), F.round(F.greatest(start, end), 3).alias("end"),
            c["measure"].alias("measure"), c["beat"].alias("beat"), F.coalesce(said(c["category"]), F.lit("interpretation")).alias("category"), F.coalesce(said(c["severity"]), F.lit("warn")).alias("severity"),
            F.trim(F.coalesce(said(c["summary"], c["title"]), F.lit(""))).alias("summary"), F.trim(F.coalesce(said(c["text"], c["message"]), F.lit(""))).alias("text"), F.coalesce(said(c["confidence"]), F.lit("medium")).alias("confidence"),
        )

    # a null stands where the array holds something else than an object
    placed = F.filter(F.transform(given, lambda c, i: F.when(c.isNotNull(), F.struct(normal(c, i)["start"].alias("at"), i.alias("i"), normal(c, i).alias("c")))), lambda x: x.isNotNull())
    return F.transform(F.array_sort(F.coalesce(placed, F.expr("cast(array() as array<struct<at: double, i: int, c: struct<start: double, id: string, end: double, measure: int, beat: double, category: string, severity: string, summary: string, text: string, confidence: string>>>)"))), lambda x: x["c"])


def rows_of(body: Column, schema: str) -> Column:
    """The rows of a document that is an array of objects, or an object whose field ``notes`` is one; rows that are no
    objects are left out, and any other document has none."""
    value = F.try_parse_json(body)
    either = F.coalesce(objects(value, schema), objects(F.try_variant_get(value, "$.notes", "variant"), schema))
    return F.filter(F.coalesce(either, F.from_json(F.lit("[]"), f"array<{schema}>")), lambda r: r.isNotNull())
