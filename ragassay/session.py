"""Session helpers: shipping the package to executors, durable intermediate results."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="ragassay-")
        archive = shutil.make_archive(
            os.path.join(folder, "ragassay"), "zip", os.path.dirname(home), os.path.basename(home)
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Only a local master may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ragassay-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage behind expensive or remote stages with a written table.

    The rows go to the shared folder, so a lost executor re-reads them instead
    of embedding, generating or judging again, and readers take the columns
    they need.
    """
    folder = _scratch.get() or f"{checkpoint_folder(df.sparkSession)}/ragassay"
    path = f"{folder}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it intermediate tables go to a folder of their own, deleted at its end.

    Write a result inside: what is left of it as a plan reads tables that are gone after.
    """
    folder = f"{checkpoint_folder(spark)}/ragassay/{uuid.uuid4()}"
    before = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
