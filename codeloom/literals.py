"""Small tables from values in the program."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A DataFrame of a few rows; they reach the JVM as one Arrow table, so no Python worker starts and the
    planner knows their size."""
    schema = StructType.fromDDL(ddl)
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)
