"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


@udtf(returnType=StructType([StructField("clause", IntegerType()), StructField("text", StringType())]), useArrow=False)
class SplitClauses:
    """The clauses of a text cut to a line limit, in order; a null text has none."""

    def eval(self, text: str, limit: float, loc: str) -> Iterator[tuple[int, str]]:
        from ..operators.align import clauses

        yield from enumerate(clauses(text, limit, loc) if text is not None else ())


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: ``FROM cues c, LATERAL split_clauses(c.text, 42D, 'en') s``."""
    spark.udtf.register("split_clauses", SplitClauses)
