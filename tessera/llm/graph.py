"""Joins and graph steps that near-duplicate operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MEMBER_BITS = 1 << 24


def _slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(MEMBER_BITS)) + 1


def likely_members(rows: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``members``: for a join by ``key``.

    A bitmap of MEMBER_BITS hashed members, 2 MB at any size of the tables, is broadcast and drops rows where they are read.
    """
    slot = members.select(_slot(F.col(member)).alias("slot"))
    bitmap = slot.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    at = F.bitmap_bit_position(_slot(F.col(key)))
    byte = F.conv(F.hex(F.substr("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(_slot(F.col(key))) == F.col("bucket"))
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns))


def keep_members(rows: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """The rows whose ``key`` is among ``members``.

    ``likely_members`` drops most other rows before the rest is shuffled for an exact join. It is not a semi-join, which Spark would move below the
    bitmap, to all rows. When there are too many members for the bitmap to drop anything, the join alone does the work.
    """
    distinct = members.select(F.col(member).alias("member_key")).distinct()
    return likely_members(rows, key, members, member).join(distinct, F.col(key) == F.col("member_key")).select(*rows.columns)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``); a component is named by its smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014): each node's neighbours move to the smallest one, until nothing moves. Edges never
    grow in number; a hub's neighbours are joined with one row, which adaptive execution splits.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (both.where("b > a").join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        lower = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        small = large.join(lower, F.col("a") == F.col("node")).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(small.unionAll(lower.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct(), name)
        after = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
