"""What the training-data operators share: tables in the shared folder and maps over texts."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import folder


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts to Python workers in batches of so many rows, where the session has Spark's default of 10,000.

    A worker holds a few copies of a batch, and keeps that much memory for its later tasks.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def store(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back: it cuts lineage and survives lost executors.

    lean: the shuffle files of the write go when it has ended, not when the driver's memory is cleaned.
    """
    spark, option = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    small_batches(spark)
    path, before = f"{folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(option, None)
    if lean:
        spark.conf.set(option, "true")
    try:
        df.write.parquet(path)
    finally:
        if lean and before is not None:
            spark.conf.set(option, before)
        elif lean:
            spark.conf.unset(option)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(col: str, modulus: int):
    """crc32 of the id as text, mod modulus; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, make, ddl: str) -> DataFrame:
    """mapInArrow by rows: make() returns, in the task, a function from a batch's columns (lists) to the output's columns."""
    small_batches(df.sparkSession)
    schema = arrow_schema(ddl)
    names = df.columns

    def run(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(*[batch.column(n).to_pylist() for n in names])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)
