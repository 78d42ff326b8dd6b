"""Tables shared between the driver and all executors, and small session helpers.

Intermediate results that are read more than once are written as Parquet below
``spark.checkpoint.dir``: a lost executor then costs a re-read, not a recomputation, and the
plans that follow start from a scan. A caller that stores an operator's result can delete the
tables behind it: ``made`` notes them and ``delete_made`` deletes them, and no others.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIVE: list[str] = []
_NOTED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        root = tempfile.mkdtemp(prefix="wiretide-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/wiretide-{uuid.uuid4().hex}/{name}"


@contextmanager
def made(paths: list[str]) -> Iterator[None]:
    """Notes the tables that are written within."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED[:] = [x for x in _NOTED if x is not paths]


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _LIVE.append(path)
    for paths in _NOTED:
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by ``table`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "shared_path", None)
        if path in _LIVE:
            delete(t.sparkSession, path)
            _LIVE.remove(path)


def delete_made(spark: SparkSession, paths: list[str]) -> None:
    """Delete noted tables; call it only when the results built on them are stored."""
    while paths:
        path = paths.pop()
        if path in _LIVE:
            delete(spark, path)
            _LIVE.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a place that ``new_path`` gave."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df by name, for selecting them again after a join."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
