"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Scratch folder of the steps under way, where they have one of their own.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(master: str | None = None, app_name: str = "ragtables", **conf: str) -> SparkSession:
    """Session with the settings the operators are meant to run under; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # Lookups against unique keys rely on run-time splitting of hot keys.
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans are built from many small expressions; recording a call site for each takes longer than the rest.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Cells hold whole pages and documents, so Arrow batches are bounded by bytes as well as by rows.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path under the shared folder of ``spark.checkpoint.dir``; only a local session may go without one."""
    base = _FOLDER.get() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ragtables-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this code has written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing_scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What the steps within write to the shared folder goes at their end; no table read from it may be used afterwards."""
    path = scratch_path(spark, name)
    token = _FOLDER.set(path)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        drop_folder(spark, path)


@contextlib.contextmanager
def _settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session for the time of one write."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def write_compact(df: DataFrame, path: str, arrow_rows: int | None = None) -> None:
    """Write a table in about half of the usual bytes; shuffle files of the write go with it, not when the driver happens to
    collect its garbage. At most ``arrow_rows`` rows go to Python together."""
    settings = {_DROP_SHUFFLES: "true"}
    if arrow_rows and not 0 < int(df.sparkSession.conf.get(_ARROW_ROWS)) <= arrow_rows:
        settings[_ARROW_ROWS] = str(arrow_rows)
    with _settings(df.sparkSession, **settings):
        df.write.option("compression", "zstd").parquet(path)


def materialize(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    write_compact(df, path, arrow_rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy per-row work enough tasks when a scan has fewer splits than cores; a no-op on big inputs.

    For scans and projections of scans only: asking a plan with shuffles for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys)
