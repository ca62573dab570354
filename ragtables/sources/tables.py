"""Table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None,
         schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan. Filter and column list reach the scan as pushed filters and read schema."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, table: str, split_column: str, lower: int, upper: int, splits: int,
              **properties: str) -> DataFrame:
    """Scan of a live database in parallel ranges of a numeric column; the driver jar is the user's to supply."""
    return spark.read.jdbc(url, table, column=split_column, lowerBound=lower, upperBound=upper,
                           numPartitions=splits, properties=properties)


def read_all(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
