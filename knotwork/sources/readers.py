"""Tables from files. A list of files is one table; readers' options are honoured."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.encode import fine


def read_csv(spark: SparkSession, files: Sequence[str] | str, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """CSV files with a header; without a schema it is inferred from the first file."""
    files = [files] if isinstance(files, str) else list(files)
    reader = spark.read.options(header=True, **options)
    schema = schema or reader.option("inferSchema", True).csv(files[0]).schema
    return spark.read.options(header=True, **options).schema(schema).csv(files)


def read_dtype(spark: SparkSession, column: str, file: str, **options: Any) -> T.DataType:
    return spark.read.options(header=True, inferSchema=True, **options).csv(file).schema[column].dataType


def read_unique(df: DataFrame, column: str) -> list[Any]:
    """Distinct values, ascending."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def read_cov(df: DataFrame, response: str, column: str) -> DataFrame:
    """One covariate where the response is known."""
    return df.where(fine(response)).select(column)


def read_cov_no_cor(df: DataFrame, column: str) -> DataFrame:
    """One covariate, all rows, with the file each comes from."""
    return df.select(column, F.input_file_name().alias("file"))
