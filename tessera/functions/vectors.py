"""Cosine similarity against many vectors, in blocks with numpy inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .ranking import top_k

# Vectors in a block; two blocks are all a task multiplies at once.
BLOCK_ROWS = 4096
# Rows of the ranked side that are multiplied at once, so that a task holds a sixteenth of a block's product and no more.
TILE_ROWS = 256


def _blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``ids, matrix``: the rows' unit vectors in blocks of at most ``size``, packed where they lie."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at:at + size].sort_values(key)
                matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in part[vector]])
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                yield pd.DataFrame({"ids": [part[key].tolist()], "matrix": [(matrix / np.where(norms == 0, 1.0, norms)).tobytes()]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(pack, f"ids array<{kind}>, matrix binary")


def _best(a: np.ndarray, b: np.ndarray, k: int, per: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``a`` and in ``b`` and scores of each tile's ``k`` best, equal scores by place."""
    owners, others = (b, a) if per == "right" else (a, b)
    for at in range(0, len(owners), TILE_ROWS):
        scores = np.round(owners[at:at + TILE_ROWS] @ others.T, 9)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        own, other = np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()
        yield (other, own + at, scores[own, other]) if per == "right" else (own + at, other, scores[own, other])


def score_topk(left: DataFrame, left_id: str, right: DataFrame, right_id: str, k: int,
               vector: str = "embedding", per: str = "right", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top ``k`` cosine pairs between a large ``left`` and a smaller ``right``.

    ``per="right"`` ranks left rows for every right row (nearest neighbours);
    ``per="left"`` ranks right rows for every left row (nearest centroid).
    Both sides are packed into blocks; the right blocks are numbered and each left block meets each number once, by an equi-join that Spark
    broadcasts only below its own threshold. Every product is trimmed to its own k best before anything is shuffled again. Scores
    are rounded to 9 places so that ties fall to the smaller id.
    """
    left_type = left.schema[left_id].dataType.simpleString()
    right_type = right.schema[right_id].dataType.simpleString()
    # A few tasks pack the right side, so that its blocks are full.
    packed = materialise(_blocks(right.coalesce(8), right_id, vector, block_rows).withColumn("place", F.monotonically_increasing_id()), "vector_blocks")
    numbered = packed.join(packed.select("place", (F.row_number().over(Window.orderBy("place")) - 1).alias("block")), "place").select(  # one number per block
        "block", F.col("ids").alias("right_ids"), F.col("matrix").alias("right_matrix"))
    blocks = packed.count()
    pairs = _blocks(left, left_id, vector, block_rows).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks else \
        _blocks(left, left_id, vector, block_rows).where("false").withColumn("block", F.lit(0))
    pairs = pairs.join(numbered, "block").select("ids", "matrix", "right_ids", "right_matrix")

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, matrix, right_ids, right_matrix in batch.itertuples(index=False):
                a = np.frombuffer(matrix).reshape(len(ids), -1)
                b = np.frombuffer(right_matrix).reshape(len(right_ids), -1)
                for li, ri, scores in _best(a, b, k, per):
                    yield pd.DataFrame({left_id: np.asarray(ids)[li], right_id: np.asarray(right_ids)[ri], "score": scores})

    found = pairs.mapInPandas(trim, f"`{left_id}` {left_type}, `{right_id}` {right_type}, score double")
    owner, other = (right_id, left_id) if per == "right" else (left_id, right_id)
    return top_k(found, [owner], [F.desc("score"), F.col(other)], k)


def mean_vectors(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean vector per label, as (label, embedding).

    The means are taken per (label, position) with map-side partial sums, so a
    label holding most of the rows costs one partial sum per task.
    """
    return (
        df.select(label, F.posexplode(vector).alias("pos", "x"))
        .groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("cells"))
        .select(label, F.col("cells.m").alias("embedding"))
    )
