"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``).

Written tables cut lineage and survive lost executors.  Their files go when the ``scratch`` block that they were made in
ends, and all that are left when the application does.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Paths made within the innermost block; a context has its own, so threads don't delete each other's files.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see.  Only a local master may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, to be deleted with its block or at the end of the application."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    text = df.schema.json()
    if '"void"' in text:  # nulls without a type cannot be written
        df = df.to(StructType.fromJson(json.loads(re.sub(r'ype":"void"', 'ype":"string"', text))))
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end the files of the tables that were made within, but for those written by the function it gives."""
    outer = _made.get()
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = materialize(df, label)
        kept.append(made.pop())
        return out

    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        if outer is not None:
            outer.extend(kept)
        for path in made:
            delete(spark, path)
