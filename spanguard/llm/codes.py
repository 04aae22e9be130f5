"""Product codes of vectors: k-means codebooks of vector parts, searched by VA-file filtering.

Each codebook's entries are held as cells of a few bits for each coordinate. A vector's part looks the least and
greatest distance to each cell up in tables of its own; sums of those bracket its distance to every entry, and only
entries whose bracket overlaps the best one are measured exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_column, cut, map_arrow, parts, table
from .vectors import matrix, taking_part

#: Parts of a vector, entries of a codebook at most, rounds of k-means, bits of a cell.
PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 4
#: Sums by label are broadcast up to so many labels; beyond, they are joined by a shuffle whose hot parts can be split.
FEW_LABELS = 1 << 16


class Cells:
    """VA-file of one codebook: entries x width whole numbers."""

    def __init__(self, entries: np.ndarray) -> None:
        n, width = entries.shape
        groups = np.array_split(np.arange(n), min(n, 1 << BITS))
        order = np.argsort(entries, axis=0, kind="stable")
        self.entries = entries
        self.cell = np.empty((width, n), np.intp)
        self.low = np.empty((width, len(groups)), np.int64)
        self.high = np.empty_like(self.low)
        for d in range(width):
            for c, g in enumerate(groups):  # as many entries in each cell; its ends are those of its entries
                at = order[g, d]
                self.cell[d, at] = c
                self.low[d, c], self.high[d, c] = entries[at[0], d], entries[at[-1], d]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, ties to the lower one; squared distance) for each row of x."""
        n, k = len(x), len(self.entries)
        least, most = np.zeros((n, k), x.dtype), np.zeros((n, k), x.dtype)
        for d in range(x.shape[1]):
            below, above = self.low[d].astype(x.dtype) - x[:, d, None], x[:, d, None] - self.high[d].astype(x.dtype)
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)  # from x to the farther end: x - low or high - x
            least += (near * near).take(self.cell[d], axis=1)
            most += (far * far).take(self.cell[d], axis=1)
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        exact = ((x[row] - self.entries.astype(x.dtype)[entry]).astype(np.int64) ** 2).sum(axis=1)
        start = np.searchsorted(row, np.arange(n))
        best = np.minimum.reduceat(exact, start)
        hit = np.nonzero(exact == best[row])[0]
        first = hit[np.searchsorted(row[hit], np.arange(n))]
        return entry[first], best


def assign(x: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts entry indexes, rows x parts squared distances)."""
    width = x.shape[1] // len(books)
    bound = max([int(np.abs(x).max(initial=0)), *(int(np.abs(b.entries).max(initial=0)) for b in books)])
    narrow = x.astype(np.int32) if (2 * bound) ** 2 * max(width, 1) < 1 << 31 else x
    found = [b.nearest(narrow[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """parts x entries x (width + 1): sums of the components of what is nearest to each entry, and its count."""
    many, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total = [Cells(b) for b in books], np.zeros((many, k, width + 1), np.int64)
        for batch in parts(batches):
            x = matrix(as_column(batch, "q"), many * width)
            at, _ = assign(x, cells)
            for p in range(many):
                np.add.at(total[p, :, :width], at[:, p], x[:, p * width : (p + 1) * width])
                total[p, :, width] += np.bincount(at[:, p], minlength=k)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total.ravel()[cell])], ["cell", "v"])

    out = np.zeros(many * k * (width + 1), np.int64)
    for r in map_arrow(rows.select("q"), run, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # a codebook's size
        out[r.cell] = r.v
    return out.reshape(many, k, width + 1)


def train(rows: DataFrame, n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks, parts x entries x width, of rows with (id, q); None for an empty table.

    They start as the parts of the smallest ids (nulls last, of equal ids by components). Each round takes one pass
    over all rows; tasks send sums, not rows.
    """
    dim = rows.agg(F.max(F.size("q"))).first()[0]
    if dim is None:
        return None
    width = max(1, -(-dim // n_parts))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    start = matrix(pa.array([r.q for r in first], pa.list_(pa.int32())), n_parts * width)
    books = start.reshape(len(first), n_parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        total = _sums(rows, books)
        n = total[:, :, -1:]
        books = np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits for each part), error (sum of squared distances) of rows with (id, label, q)."""
    many, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in parts(batches):
            at, far = assign(matrix(as_column(batch, "q"), many * width), cells)
            codes = [bytes(r).hex() for r in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([as_column(batch, "id"), as_column(batch, "label"), pa.array(codes, pa.string()), pa.array(far.sum(1, dtype=np.int64))], ["id", "label", "code", "error"])

    return map_arrow(rows, run, "id long, label long, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 for each row with a finite vector.

    Rows with a null vector, or null or non-finite components, are left out. Shorter vectors count as if zeros
    followed, up to the longest's length or the next multiple of the parts. Null labels are one group, null ids come
    last, repeated rows are each returned; an empty table gives no rows.
    """
    rows = taking_part(vectors, id_col, label_col, vec_col)
    books = train(rows)
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` long, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode(rows, books))
    totals = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    side = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    out = coded.join(side, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    dist = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    near = lambda k: f"SELECT p.r, p.part, min({dist} * {ENTRIES} + b.e) AS best FROM p JOIN b{k} b ON b.part = p.part GROUP BY ALL"
    book = lambda k: f"""
a{k} AS MATERIALIZED ({near(k)}),
m{k} AS (SELECT p.part, a.best % {ENTRIES} AS e, i, CAST(floor(sum(p.v[i]) / count(*)) AS BIGINT) AS c
  FROM p JOIN a{k} a ON a.r = p.r AND a.part = p.part, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM p))) AS i) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.v, b.v) AS v FROM b{k} b
  LEFT JOIN (SELECT part, e, list(c ORDER BY i) AS v FROM m{k} GROUP BY ALL) n ON n.part = b.part AND n.e = b.e)"""  # noqa: E731
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, part, q[part * len(q) // {PARTS} + 1 : (part + 1) * len(q) // {PARTS}] AS v FROM k, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM p WHERE r <= {ENTRIES}),{",".join(book(k) for k in range(ROUNDS))},
f AS (
  SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM ({near(ROUNDS)}) GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN f USING (r), s
"""


SQL = _sql()
