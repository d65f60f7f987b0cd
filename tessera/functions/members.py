"""Semi-joins that drop most rows before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the map of members, in words of 64: at most 262,144 rows, at any size of the tables.
MEMBER_BITS = 1 << 24


def _slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(MEMBER_BITS))


def likely_members(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among the ``key`` values of ``members``, a stored table: for a join by ``key``.

    A bitmap of hashed members, of fixed size, goes to every task and drops rows where they are read.
    """
    slot = _slot(F.col(key))
    word, bit = F.shiftright(slot, 6), (slot % 64).cast("int")
    words = members.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return rows.join(F.broadcast(words), word == F.col("_word")).where(F.getbit("_bits", bit) == 1).select(*rows.columns)


def keep_members(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among the ``key`` values of ``members``, a stored table.

    ``likely_members`` drops most other rows; an exact join does the rest. It is not a
    semi-join, which Spark would move below the map, to all rows. With too many members
    for the map to drop anything, the join alone does the work.
    """
    return likely_members(rows, key, members).join(members.select(key).distinct(), key).select(*rows.columns)
