"""Top-k, distributed ranks and exact percentiles, none of which gather a group in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_BUCKET_CHARS = 4  # 65,536 hash buckets per group
TRIM_ROWS = 1 << 16  # rows a task holds before it cuts them


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank",
          first: int = 1) -> DataFrame:
    """The first ``k`` rows per key, ranked from ``first``.

    The bound is a literal on a bare row_number, so Spark trims every partition
    to k rows per key before the shuffle; a hot key sends k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank) + (first - 1)) if first != 1 else ranked


def _first_rows(rows: pa.Table, key: str, order: Sequence[str], k: int) -> pa.Table:
    """The first ``k`` rows per key, null before others and texts by their bytes."""
    group = rows[key].combine_chunks().dictionary_encode("encode").indices
    columns = {"group": group} | {f"by_{c}": rows[c] for c in order}
    at = pc.sort_indices(pa.table(columns), sort_keys=[(c, "ascending") for c in columns], null_placement="at_start").to_numpy()
    starts = np.flatnonzero(np.diff(group.to_numpy()[at], prepend=-1))
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
    return rows.take(pa.array(at[rank < k]))


def top_k_by_text(df: DataFrame, key: str, order: Sequence[str], k: int) -> DataFrame:
    """``top_k`` in the order of text columns, for rows far more than are kept.

    Spark's trim sorts all rows of a task, on disk where they are many. Here a task cuts every ``TRIM_ROWS`` of them
    to k per key where they are read, and sends them on if that leaves most of them, so it never holds more; the rest is ranked by ``top_k``.
    """
    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TRIM_ROWS:
                left = _first_rows(pa.Table.from_batches(held), key, order, k)
                held, n = left.to_batches(), left.num_rows
                if n > TRIM_ROWS // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from _first_rows(pa.Table.from_batches(held), key, order, k).to_batches()

    return top_k(df.mapInArrow(trim, df.schema), [key], [F.col(c) for c in order], k)


def count_and_ends(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, least, most): the rows of each group and the first and last text ``value`` among them.

    Spark orders all rows by group to find the least text of each, on disk where they are many; here every batch is
    folded where it is read, and only its groups go on. The text's order is that of its bytes, as in Spark.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(list(keys), use_threads=False).aggregate(
                [([], "count_all"), (value, "min"), (value, "max")]).select([*keys, "count_all", f"{value}_min", f"{value}_max"])
            yield from found.rename_columns([*keys, "n", "least", "most"]).to_batches()

    kinds = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)
    return rows.select(*keys, value).mapInArrow(fold, f"{kinds}, n bigint, least string, most string").groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def seeded_hash(seed: int | str, *cols: str) -> Column:
    """Reproducible random order: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def spread_rank(df: DataFrame, groups: Sequence[str], key: str, hash_col: str, rank: str = "rank") -> DataFrame:
    """1-based rank by ``(hash_col, key)`` within each group, plus the group size ``group_size``.

    Rows are ranked inside hash buckets and shifted by the number of rows in
    earlier buckets, so a group holding a third of all rows is still spread
    over 65,536 windows. Only the bucket counts are seen per group.
    """
    bucketed = df.withColumn("_bucket", F.substring(hash_col, 1, HASH_BUCKET_CHARS))
    keys = [*groups, "_bucket"]
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = counts.select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("group_size"))
    inside = Window.partitionBy(*keys).orderBy(hash_col, key)
    return (
        bucketed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(rank, F.col("_inside") + F.col("_offset"))
        .drop("_bucket", "_inside", "_offset")
    )


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str,
                      wanted: dict[str, float], interpolate: bool = True) -> DataFrame:
    """Exact percentiles per group: linear interpolation, or the value at index ``int(q * (n - 1))``.

    A quantile sketch first brackets each wanted position; then only the values
    inside the brackets, already counted per distinct value, are ordered. The
    rows ordered per group are a fixed small share of the group.
    """
    slack = 0.0005  # sketch accuracy 10,000 gives a rank error of at most 0.0001
    keys = list(groups)
    one = not keys
    if one:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    df = df.where(F.col(value).isNotNull())
    bounds = []
    for q in wanted.values():
        bounds += [max(0.0, q - slack), min(1.0, q + slack)]
    sketch = df.groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*[F.lit(b) for b in bounds]), 10000).alias("_cut"),
        F.count(F.lit(1)).alias("_n"))
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    result = sketch.select(*keys, "_n")
    joined = counted.join(sketch, keys)
    for i, (name, q) in enumerate(wanted.items()):
        lo, hi = F.col("_cut")[2 * i], F.col("_cut")[2 * i + 1]
        # In a group of few rows the bracket may be one value; the values next to it serve positions just outside.
        below = joined.where(F.col(value) < lo).groupBy(*keys).agg(F.sum("_c").alias("_below"), F.max(value).alias("_prev"))
        inside = joined.where((F.col(value) >= lo) & (F.col(value) <= hi))
        above = joined.where(F.col(value) > hi).groupBy(*keys).agg(F.min(value).alias("_next"))
        running = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        placed = (
            inside.withColumn("_run", F.sum("_c").over(running))
            .join(below, keys, "left").join(above, keys, "left")
            .withColumn("_to", F.col("_run") + F.coalesce("_below", F.lit(0)))
            .withColumn("_pos", F.lit(q) * (F.col("_n") - 1))
        )
        before = lambda rank: F.when(rank < F.max(F.coalesce("_below", F.lit(0))), F.max("_prev"))
        if interpolate:
            lower, upper = F.floor("_pos"), F.ceil("_pos")
            at = placed.groupBy(*keys).agg(
                F.max("_pos").alias("_pos"), F.max("_next").alias("_next"),
                F.coalesce(before(F.max(lower)), F.min(F.when(F.col("_to") > lower, F.col(value)))).alias("_lo"),
                F.coalesce(before(F.max(upper)), F.min(F.when(F.col("_to") > upper, F.col(value)))).alias("_hi"))
            found = at.select(*keys, (
                F.col("_lo") + (F.col("_pos") - F.floor("_pos"))
                * (F.coalesce("_hi", "_next", "_lo") - F.col("_lo"))).alias(name))
        else:
            found = placed.groupBy(*keys).agg(
                F.coalesce(before(F.max(F.floor("_pos"))), F.min(F.when(F.col("_to") > F.floor("_pos"), F.col(value)))).alias(name))
        result = result.join(found, keys, "left")
    return result.drop("_n", "_all") if one else result.drop("_n")
