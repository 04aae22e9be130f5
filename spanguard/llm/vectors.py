"""Rows of a vector table as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of one that a component counts; larger ones than this count as it, so that products of them stay exact.
SCALE, MOST = 256, 1 << 26


def finite(vector: Column) -> Column:
    """True for a vector without null, infinite or undefined components; false for null. An empty one is finite."""
    one = lambda x: F.coalesce((x.cast("double") > -math.inf) & (x.cast("double") < math.inf), F.lit(False))
    return F.coalesce(F.forall(vector, one), F.lit(False))


def whole(vector: Column) -> Column:
    """Each component x as floor(SCALE * x), within MOST."""
    one = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return F.transform(vector, one)


def taking_part(rows: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, q) of the rows with a finite vector; other columns aren't read, whatever their names."""
    vector = F.col(f"`{vec_col}`")
    return rows.where(finite(vector)).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole(vector).alias("q"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """rows x dim of a list column without nulls; shorter vectors end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(len(size), dim).astype(np.int64)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def long_values(column: pa.Array, null: int) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)
