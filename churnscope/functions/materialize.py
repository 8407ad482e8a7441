"""Lineage cuts for frames that several jobs reuse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_WRITTEN: dict[str, set[str]] = {}       # application id -> paths written by ``materialize``
_SHARED: dict[tuple, DataFrame] = {}     # (application id, key, input state) -> frame of ``materialize_once``


def materialize(df: DataFrame, how: str = "table", name: str = "stage") -> DataFrame:
    """Write ``df`` once and reuse it.

    ``table`` (default) writes parquet under the shared folder named by
    ``spark.checkpoint.dir`` and reads it back: one job, a lost executor does
    not force recomputing the upstream joins, and later scans get column
    pruning and filter pushdown. ``checkpoint`` uses Spark's reliable
    checkpoint (persisted first so the data is computed once); ``cache``
    keeps it in executor memory/disk (recomputed from lineage on loss).
    ``drop_materialized`` removes the written tables.
    """
    spark = df.sparkSession
    if how == "table":
        base = ensure_checkpoint_dir(spark).rstrip("/")
        path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
        out = spark.read.parquet(path)
        out._materialized_at = path
        return out
    if how == "checkpoint":
        ensure_checkpoint_dir(spark)
        kept = df.persist()
        out = kept.checkpoint(eager=True)
        kept.unpersist()
        return out
    if how == "cache":
        return df.persist()
    return df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table written by the caller; ``drop_materialized`` removes it too."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def discard(*frames: DataFrame) -> None:
    """Remove the tables behind frames of ``materialize`` that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_materialized_at", None)
        if path:
            _WRITTEN.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def input_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Length and modification time of the given files or folders: tells a rewritten input from the one read before."""
    state = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        summary, status = fs.getContentSummary(p), fs.getFileStatus(p)
        state.append((path, summary.getLength(), summary.getFileCount(), status.getModificationTime()))
    return tuple(state)


def materialize_once(spark: SparkSession, key: str, inputs: list[str], make, name: str = "stage") -> DataFrame:
    """``materialize(make())`` once per session, key and state of the input files; written again if it was removed."""
    at = (spark.sparkContext.applicationId, key, input_state(spark, inputs))
    df = _SHARED.get(at)
    if df is None or not all(_exists(spark, f) for f in df.inputFiles()[:1]):
        df = _SHARED[at] = materialize(make(), name=name)
    return df


def drop_materialized(spark: SparkSession) -> int:
    """Remove every table that ``materialize`` wrote in this application; returns their number."""
    app = spark.sparkContext.applicationId
    paths = _WRITTEN.pop(app, set())
    for path in paths:
        _delete(spark, path)
    for key in [k for k in _SHARED if k[0] == app]:
        del _SHARED[key]
    return len(paths)
