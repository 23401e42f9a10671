"""A bitmap of ids, of one size at any input: keeps texts that a join would not meet out of its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits; 64 of them are one row of the broadcast table, which has 2**17 rows at most.
BITS = 2**23


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key.cast("long")).bitwiseAND(BITS - 1)
    return F.shiftright(h, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def split(rows: DataFrame, key: str, ids: DataFrame, own: str) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among ids, and rows whose key is not. Both read rows; neither shuffles them.

    The more ids, the more rows pass as possible ones: a full bitmap holds back nothing, and no row is ever lost."""
    word, bit = _place(F.col(own))
    known = F.broadcast(ids.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__mask")))
    word, bit = _place(F.col(key))
    marked = rows.withColumn("__word", word).join(known, "__word", "left")
    hit = F.coalesce(F.col("__mask"), F.lit(0).cast("long")).bitwiseAND(bit) != 0
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)


def possible(rows: DataFrame, key: str, ids: DataFrame, own: str) -> DataFrame:
    return split(rows, key, ids, own)[0]
