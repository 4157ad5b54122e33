"""Lineage cuts into the shared checkpoint folder (survive executor loss)."""

from __future__ import annotations

import functools
import os
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: an execution drops its shuffle files when it ends, not when the driver's heap is next collected
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scopes = threading.local()


def materialize(df: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """Write the rows as a Parquet table under ``spark.checkpoint.dir`` (a
    shared folder on a cluster) and read it back.

    This cuts the lineage like ``checkpoint()``, so a lost executor does not
    force recomputation and iterative plans stay short, and it also gives the
    optimizer fresh size statistics from the files. (A checkpointed Dataset
    keeps the estimate of the plan it came from, and in iterative self-joins
    those estimates multiply round after round.)

    A :func:`tidy` function that runs now may delete the table when it returns; with ``beside``,
    the one that may delete that table does.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "tables", uuid.uuid4().hex)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    scopes = _open() if beside is None else [s for s in _open() if getattr(beside, "_stored", None) in s]
    for paths in scopes[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_stored", None) if isinstance(t, DataFrame) and "_stored" in vars(t) else None
        if path is not None:
            _delete(t.sparkSession, path)


def tidy(run: Callable) -> Callable:
    """Decorator: the tables that a call of ``run`` stores and that its result does not read are
    deleted when it returns. The result is a DataFrame, several, or an object with ``tables``; none
    of them has a scalar subquery over such a table."""
    @functools.wraps(run)
    def call(*args, **kwargs):
        _open().append([])
        try:
            result = run(*args, **kwargs)
        finally:
            paths = _open().pop()
        frames = list(_frames(result))
        read = {os.path.basename(os.path.dirname(f)) for df in frames for f in df.inputFiles()}
        for path in paths:
            if frames and os.path.basename(path) not in read:
                _delete(frames[0].sparkSession, path)
            else:
                for outer in _open()[-1:]:
                    outer.append(path)
        return result
    return call


def _open() -> list[list[str]]:
    """The paths written so far by each call of a :func:`tidy` function that runs in this thread."""
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    return _scopes.stack


def _frames(x) -> Iterator[DataFrame]:
    if isinstance(x, DataFrame):
        yield x
    elif isinstance(x, tuple | list):
        for v in x:
            yield from _frames(v)
    elif hasattr(x, "tables"):
        yield from _frames(list(x.tables.values()))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
