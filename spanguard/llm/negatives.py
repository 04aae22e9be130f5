"""Hard negatives, by a pivot table.

A row gets one more component, so that all rows are equally long: then a greater inner product with an anchor is a
smaller Euclidean distance to it. Each row's distances to a few pivots are stored; by the triangle inequality they
bracket its distance to any anchor, and so its score. Only rows whose bracket meets what is asked for are checked.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_column, cut, map_arrow, parts, remove, shared_dir, table
from .vectors import long_values, matrix, taking_part

#: Pivots, and rows of the smallest ids that they are chosen from; any choice gives the same results.
PIVOTS, CHOICE = 8, 1024
#: Positives of an anchor and negatives of a positive; percent of the positive's score that a negative's may have.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Anchors that go to all tasks at a time: so many bytes of components, and so many rows, at most.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 4096
#: Anchors compared with a slice of rows at a time.
TILE = 256
#: Stands for a null id, which comes last.
LAST = np.iinfo(np.int64).max


def choose_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows that lie far from each other: each next one has the greatest distance to those chosen."""
    chosen = [0]
    near = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(rows)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """x with one more component, which makes each row as long as the longest."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x.astype(float) ** 2).sum(1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def brackets(asked: np.ndarray, squares: np.ndarray, stored: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score of each anchor with each row, from distances to the pivots.

    asked: anchors x pivots, squares: the anchors' squared lengths, stored: rows x pivots. Rounding is allowed for.
    """
    low, high = np.zeros((len(asked), len(stored))), np.full((len(asked), len(stored)), np.inf)
    for a, r in zip(asked.T, stored.T):
        np.maximum(low, np.abs(a[:, None] - r), out=low)
        np.minimum(high, a[:, None] + r, out=high)
    both = (squares + longest)[:, None]
    slack = 1 + 1e-9 * (both + high**2)
    return (both - high**2) / 2 - slack, (both - low**2) / 2 + slack


class Best:
    """The first few rows of each of several lists, by score, then id, then place."""

    def __init__(self, lists: int, few: int) -> None:
        self.few, self.rows = few, [np.zeros((0, 3), np.int64) for _ in range(lists)]
        self.least = np.full(lists, -np.inf)  # scores below it can't enter a list any more

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        rows = np.concatenate([self.rows[at], np.stack([scores, ids, places], 1)])
        self.rows[at] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.few]]
        if len(self.rows[at]) == self.few:
            self.least[at] = self.rows[at][-1, 0]

    def batch(self, name: str) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(self.rows)), [len(r) for r in self.rows])
        rows = np.concatenate([np.zeros((0, 3), np.int64), *self.rows])
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(3))], [name, "score", "id", "place"])


class Block:
    """Anchors that all tasks get, and the search for them among the rows of a task."""

    def __init__(self, found: list, dim: int, longest: float, pivots: np.ndarray) -> None:
        ints = pa.list_(pa.int32())
        self.x = matrix(pa.array([r.q for r in found], ints), dim)
        self.far = _distances(np.column_stack([self.x, np.zeros(len(self.x))]), pivots)  # as a query it gets no length
        self.label = np.array([r.label for r in found], np.int64)
        self.place = np.array([r.place for r in found], np.int64)
        self.squares = (self.x**2).sum(1).astype(float)
        self.dim, self.longest = dim, longest

    def scores(self, batches: Iterator[pa.RecordBatch], same: bool, least, most) -> Iterator[tuple]:
        """(anchors, scores, mask, ids, places) for each tile of anchors and slice of rows with survivors.

        least() and most(): the scores that each anchor still asks for; same: of rows of its label, or of others.
        """
        fits = 2.0 * self.longest < 1 << 52  # else products of doubles aren't exact
        for batch in parts(batches):
            x = matrix(as_column(batch, "q"), self.dim)
            ids, places, labels = long_values(as_column(batch, "id"), LAST), long_values(as_column(batch, "place"), 0), long_values(as_column(batch, "label"), 0)
            stored = as_column(batch, "far").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            for s in range(0, len(self.x), TILE):
                at = np.arange(s, min(s + TILE, len(self.x)))
                low, high = brackets(self.far[at], self.squares[at], stored, self.longest)
                alive = (high >= least()[at, None]) & (low <= most()[at, None])
                alive &= (self.label[at, None] == labels) == same
                if same:
                    alive &= self.place[at, None] != places
                a, r = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
                if a.size:  # one product checks the anchors and rows that have survivors
                    left, right = self.x[at[a]], x[r]
                    exact = (left.astype(float) @ right.T.astype(float)).astype(np.int64) if fits else left @ right.T
                    yield at[a], exact, alive[np.ix_(a, r)], ids[r], places[r]

    def nearest(self, few: int):
        """For mapInArrow: the first rows of each anchor's own label."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(self.x), few)
            without = np.full(len(self.x), np.inf)
            for at, exact, alive, ids, places in self.scores(batches, True, lambda: best.least, lambda: without):
                alive &= exact >= best.least[at, None]
                for k in np.nonzero(alive.any(1))[0]:
                    best.add(at[k], exact[k, alive[k]], ids[alive[k]], places[alive[k]])
            yield best.batch("anchor")

        return run

    def within(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, few: int):
        """For mapInArrow: the first rows of other labels in each window (anchor, least and greatest score)."""
        order = np.argsort(anchor, kind="stable")
        first = np.searchsorted(anchor[order], np.arange(len(self.x) + 1))
        most = np.full(len(self.x), -np.inf)
        np.maximum.at(most, anchor, high)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(anchor), few)

            def least() -> np.ndarray:
                out = np.full(len(self.x), np.inf)
                np.minimum.at(out, anchor, np.maximum(low, best.least))
                return out

            for at, exact, alive, ids, places in self.scores(batches, False, least, lambda: most):
                of = [(k, w) for k, a in enumerate(at) for w in order[first[a] : first[a + 1]]]
                if not of:
                    continue
                row, window = np.array(of).T
                hit = alive[row] & (exact[row] >= np.maximum(low, best.least)[window, None]) & (exact[row] <= high[window, None])
                for k in np.nonzero(hit.any(1))[0]:
                    best.add(window[k], exact[row[k], hit[k]], ids[hit[k]], places[hit[k]])
            yield best.batch("window")

        return run


def pivot_table(rows: DataFrame) -> tuple[DataFrame, int, float, np.ndarray] | None:
    """(id, label, q, place, far: distances to the pivots) of rows with (id, label, q); dimension, longest square, pivots.

    None for an empty table. place numbers the rows.
    """
    square = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    dim, longest = rows.agg(F.max(F.size("q")), F.max(square)).first()
    if dim is None:
        return None
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(CHOICE).select("q").collect()
    sample = augmented(matrix(pa.array([r.q for r in first], pa.list_(pa.int32())), dim), longest)
    pivots = choose_pivots(sample, PIVOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            far = _distances(augmented(matrix(as_column(batch, "q"), dim), longest), pivots)
            yield pa.RecordBatch.from_arrays([*(as_column(batch, c) for c in ("id", "label", "q", "place")), pa.array(list(far), pa.list_(pa.float64()))], ["id", "label", "q", "place", "far"])

    numbered = rows.withColumn("place", F.monotonically_increasing_id())
    return cut(map_arrow(numbered, run, "id long, label long, q array<int>, place long, far array<double>")), dim, float(longest), pivots


def _first(found: DataFrame, by: str, few: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor tells which rows are anchors, as a condition on `id` and `label`. An anchor's positives are the first
    POSITIVES other rows of its label; a positive's negatives are the first NEGATIVES rows of other labels whose score
    is LEAST to MOST percent of the positive's. Higher scores come first, then smaller ids (nulls last). Rows with a
    null label, a null vector, or null or non-finite components take no part; shorter vectors count as if zeros
    followed. Repeated rows each take part, as others than their twins; an empty table gives no rows.

    Anchors go to the tasks in blocks of bounded size, each block against all rows, in two passes.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    made = pivot_table(taking_part(vectors, id_col, label_col, vec_col).where("label IS NOT NULL"))
    if made is None:
        return spark.createDataFrame([], schema)
    rows, dim, longest, pivots = made
    anchors = cut(rows.where(anchor).drop("far"))
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim, 1))))
    folder = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    remove(spark, folder, at_exit=True)
    last, number = -1, 0
    while found := anchors.where(F.col("place") > last).orderBy("place").limit(size).collect():
        last, number = found[-1].place, number + 1
        block = Block(found, dim, longest, pivots)
        positives = _first(map_arrow(rows, block.nearest(POSITIVES), "anchor long, score long, id long, place long"), "anchor", POSITIVES).collect()
        low = np.array([-(-LEAST * p.score // 100) for p in positives], np.int64)
        high = np.array([MOST * p.score // 100 for p in positives], np.int64)
        of = np.array([p.anchor for p in positives], np.int64)
        negatives = _first(map_arrow(rows, block.within(of, low, high, NEGATIVES), "window long, score long, id long, place long"), "window", NEGATIVES)
        given = [(k, found[p.anchor].id, None if p.id == LAST else p.id, p.score) for k, p in enumerate(positives)]
        windows = spark.createDataFrame(given, "of long, anchor_id long, positive_id long, positive_score long")
        # As many windows as positives of a block.
        out = negatives.join(F.broadcast(windows), F.col("window") == F.col("of"))
        negative = F.when(F.col("id") != int(LAST), F.col("id"))
        out.select("anchor_id", "positive_id", "rank", negative.alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{folder}/{number}")
    return spark.read.schema(schema).parquet(f"{folder}/*") if number else spark.createDataFrame([], schema)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("id") % 100 == 0)


SQL = f"""
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
