"""Where tables that cut lineage go: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  A local session without one, as in tests, gets a folder of this machine; a cluster has to name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: The folder, below the application's, of the step that this thread is in.
_step: ContextVar[str] = ContextVar("step", default="")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, under this application's name."""
    return f"{_own_folder(spark)}{_step.get()}/{name}-{uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application stored.  DataFrames that were built from it can't be read any more: call it when their results are written."""
    _delete(spark, _own_folder(spark))


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """What this thread stores inside is deleted at the end, but for tables that ``outlive`` it."""
    token = _step.set(f"/step-{uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, f"{_own_folder(spark)}{_step.get()}")
        _step.reset(token)


def stored(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again; it may ``outlive`` the ``step`` that it is stored in."""
    token = _step.set("" if outlive else _step.get())
    path = shared_path(df.sparkSession, name)
    _step.reset(token)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as tell it from ``columns`` in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
