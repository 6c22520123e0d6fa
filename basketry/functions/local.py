"""Few rows of the driver as a plan leaf."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_rows(spark: SparkSession, rows: Sequence[Sequence], schema: StructType) -> DataFrame:
    """``rows`` as a local relation, which Spark knows the size of; rows of Python objects are not."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    kinds = to_arrow_schema(schema)
    arrays = [pa.array(column, field.type) for column, field in zip(columns, kinds, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kinds), schema)
