"""What operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that aren't null or zero and hold no null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rows(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """id long, vector array<double> (usable ones only) and more columns; repeated rows come once."""
    kept = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col))
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *more]
    return kept.select(*columns).dropDuplicates()
