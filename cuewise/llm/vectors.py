"""Vector tables: which rows count, and packed forms for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(table: DataFrame, *, zero: bool) -> DataFrame:
    """(vec_id, vec): rows with an id and a vector of finite components; ``zero``: whether an all-zero one counts."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null").where(F.coalesce(finite, F.lit(False)) & (F.size("vec") > 0))
    return rows if zero else rows.where(F.exists("vec", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def of_one_length(rows: DataFrame) -> DataFrame:
    """Rows of the length that most vectors have; others cannot be compared with them."""
    lengths = rows.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "length").first()
    return rows if first is None else rows.where(F.size("vec") == first["length"])
