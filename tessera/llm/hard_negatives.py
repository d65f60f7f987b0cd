"""Hard negatives for anchors among vectors, by bounds along a spanning tree of the anchors.

Anchors lie in blocks, each with a minimum spanning tree. A candidate's exact score at one anchor bounds its score at a child in the tree: it differs by at most the edge's
length times the candidate's norm. Where that interval meets none of the child's score windows the candidate is not scored there, and its interval, widened
by the next edge, is handed on. The windows close from below as better negatives turn up. The same walk finds positives (one window without limits,
among the anchor's own label) and negatives (a window per positive, among all other labels).

Blocks of anchors meet slices of rows in a cogroup whose parts are bounded on both sides; each part gives its best few, and a window takes the best of all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import partitions, schema, stored

#: Anchors of a tree, trees that meet a slice together, rows of a slice, and rows scored at once.
BLOCK, TREES, SLICE, TILE = 1024, 8, 16384, 1024
NO_ID = (1 << 63) - 1
PLANTED = schema("label long, block int, n int, anchors binary, vectors binary, parents binary, edges binary, own binary")
NEAR = schema("label long, block int, place int, anchor_id long, own_score long, id long, score long")
MINED = schema("label long, block int, place int, number int, anchor_id long, positive_id long, positive_score long, id long, score long")


def vectors(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """One row a vector, components scaled and rounded down; shorter vectors end in zeros."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether float64 holds every product and partial sum of the two."""
    return a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53


def whole(a: np.ndarray) -> np.ndarray:
    """As Python's integers, for products that float64 would round."""
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, parents first, with each one's parent in that order and the length of the edge to it (Prim)."""
    n = len(points)
    square = (points * points).sum(axis=1)
    order, parents, edges = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    near, parent, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    at = 0
    for k in range(n):
        if k:
            at = int(np.argmin(np.where(done, np.inf, near)))
            parents[k], edges[k] = parent[at], np.sqrt(max(near[at], 0.0))
        order[k], done[at] = at, True
        away = square + square[at] - 2 * (points @ points[at])
        closer = ~done & (away < near)
        near[closer], parent[closer] = away[closer], k
    return order, parents, edges


def _plant(scale: int):
    arrow = to_arrow_schema(PLANTED)

    def run(key: tuple, part: pa.Table) -> pa.Table:
        points = vectors(part.column("embedding"), scale)
        if exact(points, points) and exact(points * points, np.ones((1, 1))):
            order, parents, edges = spanning_tree(points)
            own = (points * points).sum(axis=1).astype(np.int64)
        else:  # no bounds where lengths can't be told exactly: every score is computed
            order, parents, edges = np.arange(len(points)), np.zeros(len(points), np.int64), np.full(len(points), np.inf)
            own = np.array([sum(int(x) ** 2 for x in row) for row in points], np.int64)
        ids = part.column("vec_id").to_numpy()
        cells = (key[0].as_py(), key[1].as_py(), len(order), *(x[order].tobytes() for x in (ids, points)), parents.tobytes(), edges.tobytes(), own[order].tobytes())
        return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

    return run


class Tree:
    """A block of anchors with the windows that are asked of each: ``(low, high)`` pairs, both included, None for no limit."""

    def __init__(self, row: dict):
        self.label, self.block, n = row["label"], row["block"], row["n"]
        self.ids = np.frombuffer(row["anchors"], np.int64)
        self.points = np.frombuffer(row["vectors"]).reshape(n, -1)
        self.parents, self.edges, self.own = (np.frombuffer(row[c], k) for c, k in (("parents", np.int64), ("edges", np.float64), ("own", np.int64)))
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[self.parents[i]] + 1
        by_depth = np.argsort(depth, kind="stable")
        self.levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)


class Walk:
    """Finds the ``k`` best rows of each window of each anchor of a tree, equal scores by the rows' order."""

    def __init__(self, tree: Tree, windows: list[list[tuple[int | None, int | None]]], k: int):
        self.tree, self.windows, self.k = tree, windows, k
        self.pools: list[tuple] = [((), ()) for _ in windows]
        self.floor = np.array([min((-np.inf if a is None else a for a, _ in w), default=np.inf) for w in windows], object)
        self.roof = np.array([max((np.inf if b is None else b for _, b in w), default=-np.inf) for w in windows], object)
        self.scored = 0

    def offer(self, points: np.ndarray, allowed: np.ndarray, at: int) -> None:
        """Rows number ``at`` and on, of which ``allowed`` may be found."""
        anchors, rows = alike(self.tree.points, points)
        n, m, tree = len(anchors), len(rows), self.tree
        sure = exact(anchors, rows) and not np.isinf(tree.edges).any()
        if not sure:
            anchors, rows = whole(anchors), whole(rows)
        low, high = (np.empty((n, m), np.float64 if sure else object) for _ in range(2))
        norms = np.sqrt((rows * rows).sum(axis=1)) if sure else None
        floor, roof = (self.floor.astype(np.float64), self.roof.astype(np.float64)) if sure else (self.floor, self.roof)
        for depth, level in enumerate(tree.levels):
            sparse = level[:0]
            if sure and depth:
                # A little more than the edge allows, for what rounding takes.
                reach = np.outer(tree.edges[level] * (1 + 1e-9), norms) + 1
                low[level], high[level] = low[tree.parents[level]] - reach, high[tree.parents[level]] + reach
                needed = (high[level] >= floor[level, None]) & (low[level] <= roof[level, None])
                many = 2 * needed.sum(axis=1) > m
                sparse, level, needed = level[~many], level[many], needed[~many]
            if len(level):
                score = anchors[level] @ rows.T
                low[level] = high[level] = score
                self._hits(level, score, floor, roof, allowed, np.arange(m), at)
            for i, where in ((i, np.flatnonzero(w)) for i, w in zip(sparse, needed if len(sparse) else ())):
                if len(where):
                    score = (rows[where] @ anchors[i])[None]
                    low[i, where] = high[i, where] = score[0]
                    self._hits(np.array([i]), score, floor, roof, allowed, where, at)

    def _hits(self, level: np.ndarray, score: np.ndarray, floor: np.ndarray, roof: np.ndarray, allowed: np.ndarray, where: np.ndarray, at: int) -> None:
        self.scored += score.size
        good = ((score >= floor[level, None]) & (score <= roof[level, None])).astype(bool) & allowed[where]
        for i in np.flatnonzero(good.any(axis=1)):
            found = np.flatnonzero(good[i])
            self._take(level[i], score[i, found], at + where[found])

    def _take(self, anchor: int, score: np.ndarray, row: np.ndarray) -> None:
        pool = self.pools[anchor]
        score, row = np.concatenate([np.array(pool[0], score.dtype), score]), np.concatenate([np.array(pool[1], np.int64), row])
        order = sorted(range(len(row)), key=lambda i: (-score[i], row[i])) if score.dtype == object else np.lexsort((row, -score))
        score, row = score[order], row[order]
        keep, floor = np.zeros(len(row), bool), np.inf
        for a, b in self.windows[anchor]:
            first, last = self._span(score, a, b)
            keep[first:last] = True
            # Rows come in order, so a later one must be better than the last of k.
            floor = min(floor, score[last - 1] + 1 if last - first == self.k else -np.inf if a is None else a)
        self.pools[anchor], self.floor[anchor] = (score[keep], row[keep]), floor

    def _span(self, score: np.ndarray, a: int | None, b: int | None) -> tuple[int, int]:
        first = 0 if b is None else int((score > b).sum())
        last = len(score) if a is None else int((score >= a).sum())
        return first, max(first, min(last, first + self.k))

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """Anchor, window, row and score."""
        for anchor, (score, row) in enumerate(self.pools):
            if len(row):
                for number, (a, b) in enumerate(self.windows[anchor]):
                    for i in range(*self._span(score, a, b)):
                        yield anchor, number, int(row[i]), int(score[i])


def _slices(part: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a slice in the order of its ids."""
    part = part.sort_by("vec_id")
    return part.column("vec_id").to_numpy(), part.column("label").to_numpy(), vectors(part.column("embedding"), scale)


def _id(value: int) -> int | None:
    return None if value == NO_ID else int(value)


def _table(rows: list[tuple], arrow: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _positives(scale: int, k: int):
    arrow = to_arrow_schema(NEAR)

    def run(trees: pa.Table, part: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, _, points = _slices(part, scale)
        for row in trees.to_pylist() if len(ids) else []:
            tree = Tree(row)
            walk = Walk(tree, [[(None, None)]] * len(tree.ids), k)
            for at in range(0, len(ids), TILE):
                walk.offer(points[at:at + TILE], np.ones(len(ids[at:at + TILE]), bool), at)
            out += [(tree.label, tree.block, anchor, _id(tree.ids[anchor]), int(tree.own[anchor]), ids[i], score) for anchor, _, i, score in walk.rows()]
        return _table(out, arrow)

    return run


def _negatives(scale: int, k: int, least: int, most: int):
    arrow = to_arrow_schema(MINED)

    def run(trees: pa.Table, part: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, labels, points = _slices(part, scale)
        for row in trees.to_pylist() if len(ids) else []:
            tree, positives = Tree(row), [[] for _ in range(row["n"])]
            for one in row["windows"]:
                positives[one["place"]] = [(p["score"], p["id"]) for p in one["positives"]]
            walk = Walk(tree, [[(-(-least * s // 100), most * s // 100) for s, _ in p] for p in positives], k)
            for at in range(0, len(ids), TILE):
                walk.offer(points[at:at + TILE], labels[at:at + TILE] != tree.label, at)
            for anchor, number, i, score in walk.rows():
                s, p = positives[anchor][number]
                out.append((tree.label, tree.block, anchor, number, _id(tree.ids[anchor]), _id(p), s, ids[i], score))
        return _table(out, arrow)

    return run


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows ``(vec_id, label, embedding)`` that ``anchor`` holds for.

    Components are multiplied by ``scale`` and rounded down; a score is the integer inner product. An anchor's positives are the ``positives`` best other rows of
    its label; for each, the ``negatives`` best rows of other labels with ``least * positive <= 100 * negative <= most * positive`` are returned.
    Equal scores fall to the smaller ``vec_id``, null last.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A shorter vector ends in zeros, so an empty one scores 0 everywhere.
    Repeated rows are rows of their own: each can be anchor, positive and negative. Anchors without a positive, and positives without a
    negative in range, give no rows. Other columns are ignored. Scores that 64 bits can't hold are an error.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = stored(rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding",
                              F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
                  .where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = stored(base.groupBy("label").agg(F.ceil(F.count("row") / SLICE).cast("int").alias("slices"), F.ceil(F.count_if("is_anchor") / BLOCK).cast("int").alias("blocks"))
                   .where("blocks > 0"), "labels")
    part = lambda of, seed: F.pmod(F.xxhash64("row", F.lit(seed)), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    data = base.select("row", "vec_id", "label", "embedding")

    anchors = base.where("is_anchor").join(sizes, "label").select("label", part(F.col("blocks"), 1).alias("block"), "vec_id", "embedding")
    trees = stored(anchors.groupBy("label", "block").applyInArrow(_plant(scale), PLANTED), "trees")
    keys = ["label", "block", "slice"]
    asked = trees.join(sizes.select("label", "slices"), "label").select(*trees.columns, every(F.col("slices")).alias("slice")).repartition(n, *keys)
    given = data.join(sizes, "label").select("vec_id", "label", "embedding", part(F.col("slices"), 2).alias("slice"), every(F.col("blocks")).alias("block")).repartition(n, *keys)
    # One more than asked for, since the anchor itself is among them.
    near = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(_positives(scale, positives + 1), NEAR)
    found = _ranked(near, positives + 1, "label", "block", "place")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "score")))
    own = F.array_position(F.transform("found", lambda x: (x["id"] == F.col("anchor")) & (x["score"] == F.col("own_score"))), True).cast("int")
    others = F.filter("found", lambda x, i: i + 1 != own)
    armed = (found.groupBy("label", "block", "place").agg(ordered.alias("found"), F.first("own_score").alias("own_score"), F.first(F.coalesce("anchor_id", F.lit(NO_ID))).alias("anchor"))
             .select("label", "block", F.struct("place", F.transform(F.slice(others, 1, positives), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives")).alias("one"))
             .groupBy("label", "block").agg(F.collect_list("one").alias("windows")))
    armed = stored(trees.join(armed, ["label", "block"]), "armed")

    n_trees, n_rows = armed.count(), base.count()
    groups, slices, keys = -(-n_trees // TREES) or 1, -(-n_rows // SLICE) or 1, ["group", "slice"]
    asked = armed.select(*armed.columns, F.pmod(F.xxhash64("label", "block"), F.lit(groups)).cast("int").alias("group"), every(F.lit(slices)).alias("slice")).repartition(n, *keys)
    given = data.select("vec_id", "label", "embedding", part(F.lit(slices), 3).alias("slice"), every(F.lit(groups)).alias("group")).repartition(n, *keys)
    mined = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(_negatives(scale, negatives, least, most), MINED)
    ranked = _ranked(mined, negatives, "label", "block", "place", "number")
    real = F.when(F.col("id") != NO_ID, F.col("id"))
    return ranked.select("anchor_id", "positive_id", "rank", real.alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _ranked(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: The query's contract in DuckDB's SQL, over ``embeddings``.
ORACLE = """
WITH base AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
              FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
                FROM base a, base b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
     positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     mined AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
               FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 3
"""
