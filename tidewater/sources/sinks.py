"""Keyed sinks over Parquet tables, dealt into buckets by a hash of the key; a batch rewrites the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import stored


class Table:
    """A Parquet table under a path, partitioned by how it is dealt and by bucket; one writer at a time.

    `_dealt` has the number of buckets and the keys whose hash gives the bucket, so that a table is never taken to be
    dealt otherwise than it is: rows put there whole, or under other keys or another number, are dealt anew at the next
    merge. A merge rewrites the buckets of its keys, and so most of the table if it brings more keys than there are buckets:
    choose the number by the table's size.

    Spark swaps the partitions of a job in one after another when all are written: a job that fails before that changes
    nothing. Readers list files when they start: as with any plain Parquet table, one that is reading while a bucket is
    replaced fails and is run again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, dealt: str, mode: str) -> None:
        rows = rows.withColumn("_dealt", F.lit(dealt))
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("_dealt", "_bucket").parquet(self.path)

    def read(self) -> DataFrame | None:
        """All rows; None before the first write."""
        df = self._stored()
        return None if df is None else df.drop("_bucket", "_dealt")

    def replace(self, df: DataFrame) -> None:
        """These rows and no others."""
        self._write(df.withColumn("_bucket", F.lit(0)), "whole", "static")

    def merge(self, batch: DataFrame, keys: list[str], join) -> None:
        """Rewrite the buckets of a batch's keys as join(stored rows or None, batch); the others stay as they are."""
        dealt = f"{self.buckets} by {' '.join(keys)}"
        old = self._stored()
        if old is not None and not old.where(F.col("_dealt") != dealt).isEmpty():
            # Dealt otherwise: staged first, for a table can't be overwritten while it is read.
            again = stored(old.drop("_bucket", "_dealt").withColumn("_bucket", self.bucket(keys)), "dealt")
            self._write(again.repartition("_bucket"), dealt, "static")
            old = self._stored()
        rows = batch.withColumn("_bucket", self.bucket(keys)).persist()
        try:
            touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most `buckets`
            if old is not None:
                old = old.where(F.col("_bucket").isin(touched)).drop("_bucket", "_dealt")
            done = join(old, rows.drop("_bucket")).withColumn("_bucket", self.bucket(keys))
            self._write(done.repartition("_bucket"), dealt, "dynamic")
        finally:
            rows.unpersist()


def newest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key of the highest version; of equal versions the largest row in the order of the other columns."""
    rest = [F.desc(c) for c in df.columns if c not in (*keys, version)]
    w = Window.partitionBy(*keys).orderBy(F.desc(version), *rest)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(table: Table, batch: DataFrame, keys: list[str], version: str) -> None:
    """The newest row of each key stays; a batch replaces rows of its own version."""

    def join(old, rows):
        if old is None:
            return newest(rows, keys, version)
        both = old.withColumn("_new", F.lit(0)).unionByName(newest(rows, keys, version).withColumn("_new", F.lit(1)))
        w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
        return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")

    table.merge(batch, keys, join)


def replace_run(table: Table, rows: DataFrame, run_id: str) -> None:
    """Only this run's rows stay; a run without rows is refused."""
    if rows.isEmpty():
        raise ValueError("a run without rows doesn't replace a table")
    table.replace(rows.withColumn("run_id", F.lit(run_id)))


def replace_latest(table: Table, rows: DataFrame, run_time) -> None:
    """Keys that this run lacks go; all rows carry its time."""
    table.replace(rows.withColumn("run_at", F.lit(run_time)))


def append_frozen(table: Table, rows: DataFrame, keys: list[str]) -> None:
    """Only unstored keys are added; a stored row never changes but for an action that was null.

    Of a batch's rows of one key the smallest in the order of its columns counts.
    """
    rest = [c for c in rows.columns if c not in keys]
    fresh = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(rows.columns)

    def join(old, new):
        if old is None:
            return new
        late = new.select(*keys, F.col("action").alias("_late"))
        kept = old.join(late, keys, "left").withColumn("action", F.coalesce("action", "_late")).drop("_late")
        return kept.unionByName(new.join(old.select(*keys), keys, "left_anti"))

    table.merge(fresh, keys, join)


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with a header, or JSON lines, in the table's own partitions."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if form == "csv" else w.json(path)
