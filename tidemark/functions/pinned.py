"""Frames fixed at the moment they are read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share.

    Where it is unset, and all runs on one machine (as in tests), a temporary
    folder that is then set; on a cluster, whose machines share none, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (the master is {master})")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def pinned(df: DataFrame) -> DataFrame:
    """df as it is now, written to the shared folder: later reads see the same rows, whatever the source or an executor's loss does meanwhile."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{uuid.uuid4().hex}"
    for paths in _open.get():
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The folders of the frames that are pinned inside the block."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield paths
    finally:
        _open.reset(token)


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Removes pinned frames, by their folders; without any named, all of the shared folder, for when no run uses it any more."""
    for name in [f"{shared_dir(spark)}/tidemark"] if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
