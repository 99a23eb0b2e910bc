"""Tables staged as Parquet in the folder that all executors share, once a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str, str], tuple[str, object]] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master gets a temporary folder, and a cluster is refused, for none can be guessed there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or "cluster" in master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written in the shared folder and read again: it cuts lineage and survives lost executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Build the folder's tables anew at their next use; call it when its inputs have changed within a session."""
    for key in [k for k in _STAGED if k[:2] == (spark.sparkContext.applicationId, sf_dir)]:
        del _STAGED[key]


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table built from sf_dir, written at its first use; jobs that share it don't repeat its work.

    Within a session a folder's inputs are taken as fixed; see forget().
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        df = build()
        path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _STAGED[key] = path, df.schema
    path, schema = _STAGED[key]
    return spark.read.schema(schema).parquet(path)
