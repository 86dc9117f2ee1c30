"""Workbooks that arrive in a folder, and tables that leave as workbooks, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.cells import read_cells
from ..sources.sink import render_table, save

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_cells(spark: SparkSession, folder: str, sheet: str | None = None, files_per_batch: int = 16) -> DataFrame:
    """The cells of every file that arrives in ``folder``, each file once."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return read_cells(files, sheet, strict=False)


def write_workbooks(df: DataFrame, order: list[str], folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Workbooks for each batch.  A batch that runs again overwrites its own files.

    ``every``: a time between batches, for a query that goes on; without it, the query ends when it has written what is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save(render_table(batch, order, f"{folder}/batch-{number:06d}" + "-{part}.xlsx"), batch.sparkSession)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
