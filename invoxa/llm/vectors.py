"""Helpers of the two vector searches: usable rows, cells, the k best of all cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool) -> Column:
    """Neither null nor empty, no null or non-finite component; if not ``zero``, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    ok = vector.isNotNull() & (F.size(vector) > 0) & fine
    return ok if zero else ok & F.exists(vector, lambda x: x != 0)


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return values.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = values
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their rank, ties to the smaller vec_id.
    Spark keeps ``k`` a task before it shuffles. Rows with one id but another vector
    (``of``) are queries of their own."""
    order = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def k_best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: ``best_of`` as the searches return it."""
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
