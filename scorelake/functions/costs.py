"""Prices of model calls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefix of the model's name, dollars per million tokens of input and of output; the first prefix that
# fits counts, so a longer name after a shorter one never does.
PRICES = (
    ("gemini-3.1-pro", 1.25, 12.0),
    ("gemini-3-pro", 1.25, 12.0),
    ("gemini-pro-latest", 1.25, 12.0),
    ("gemini-3-flash", 0.3, 2.5),
    ("gemini-3.1-flash", 0.3, 2.5),
    ("gemini-flash-latest", 0.3, 2.5),
    ("gemini-flash-lite-latest", 0.1, 0.4),
    ("gemini-2.5-pro", 1.25, 10.0),
    ("gemini-2.5-flash", 0.3, 2.5),
    ("gemini-2.0-flash", 0.1, 0.4),
)
CACHED_SHARE = 0.25
# Prices of chat turns, as prefix of the model's name, dollars per million tokens of input up to and beyond
# LONG_INPUT tokens, and of output. A model without a row costs CHAT_OTHER and has no price for cached input.
CHAT = (
    ("gemini-3.1-pro", 1.25, 5.0, 12.0),
    ("gemini-3-pro", 1.25, 5.0, 10.0),
    ("gemini-2.5-pro", 1.25, 5.0, 10.0),
    ("gemini-2.5-flash", 0.075, 0.075, 0.3),
)
CHAT_OTHER_INPUT, CHAT_OTHER_OUTPUT = 1.25, 10.0
LONG_INPUT = 200_000


def _rate(model: Column, which: int) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for row in PRICES:
        out = out.when(model.startswith(row[0]), F.lit(row[which]))
    return out


def _dollars(millionths: Column) -> Column:
    """Rounded to six places by way of whole millionths, which any engine rounds alike."""
    return F.floor(millionths + 0.5) / F.lit(1e6)


def _input(asked: Column, cached: Column, rate: Column) -> Column:
    """Cached input costs a quarter and never counts for more than the input."""
    hit = F.greatest(F.lit(0), F.least(cached, asked))
    return (asked - hit) * rate + hit * rate * CACHED_SHARE


def cost(model: Column, asked: Column, answered: Column, cached: Column) -> Column:
    """Dollars of a call, null for a model without a price."""
    return _dollars(_input(asked, cached, _rate(model, 1)) + answered * _rate(model, 2))


def chat_cost(model: Column, asked: Column, answered: Column, cached: Column) -> Column:
    """Dollars of a chat turn; models without a price count as dear ones without a cache."""
    millionths = F.when(F.lit(False), F.lit(0.0))
    for prefix, short, long, out in CHAT:
        rate = F.when(asked > LONG_INPUT, F.lit(long)).otherwise(F.lit(short))
        millionths = millionths.when(model.startswith(prefix), _input(asked, cached, rate) + answered * out)
    return _dollars(millionths.otherwise(asked * CHAT_OTHER_INPUT + answered * CHAT_OTHER_OUTPUT))


def bound_usage(lines: DataFrame) -> DataFrame:
    """Order lines as model calls."""
    model = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") % 3 == 0), "gemini-3.1-pro-preview").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") % 3 == 1), "gemini-3-pro").when(F.col("l_returnflag") == "A", "gemini-2.5-pro").when(F.col("l_returnflag") == "N", "gemini-2.5-flash-lite").otherwise("other")
    asked = F.col("l_quantity") * 6000
    return lines.select(
        "l_orderkey", "l_linenumber", model.alias("model"), asked.cast("bigint").alias("input"), F.rint(F.col("l_extendedprice") / 100).cast("bigint").alias("output"), F.floor(asked * F.col("l_discount") * 12).alias("cached")
    )
