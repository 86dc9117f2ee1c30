"""``spark.read.format("workbook")``: cells of workbooks, a task for each sheet of each file.

``register`` makes it known to a session, and lets filters be pushed down to it.  Options: ``path`` (a file, a folder or a pattern; any store that
pyarrow opens), ``sheet`` (one sheet by name).  A filter ``sheet = '...'`` is pushed down, so that other sheets aren't parsed.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..errors import WorkbookError
from .cells import CELLS, cell_batches
from .detect import sheet_names


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files that a path, folder or pattern (in its last part) stands for, in order."""
    store, inner = _store(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    last = posixpath.basename(inner)
    if any(c in last for c in "*?["):
        found = [i.path for i in store.get_file_info(fs.FileSelector(posixpath.dirname(inner))) if i.is_file and fnmatch.fnmatch(i.base_name, last)]
    else:
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise WorkbookError("invalid-input", f"no file {path!r}")
        found = [inner] if info.is_file else [i.path for i in store.get_file_info(fs.FileSelector(inner)) if i.is_file and not i.base_name.startswith(("_", "."))]
    return [prefix + f for f in sorted(found)]


def _content(path: str) -> bytes:
    store, inner = _store(path)
    with store.open_input_stream(inner) as f:
        return f.read()


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str) -> None:
        super().__init__((path, sheet))
        self.path, self.sheet = path, sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sheet, self.none = options.get("path"), options.get("sheet"), False
        if not self.path:
            raise WorkbookError("invalid-input", "a workbook source needs a path")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - the interface's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",) and isinstance(f.value, str):
                self.none = self.none or self.sheet not in (None, f.value)
                self.sheet = f.value
            else:
                yield f

    def partitions(self) -> list[SheetPartition]:
        if self.none:
            return []
        return [SheetPartition(p, s) for p in listed(self.path) for s in sheet_names(_content(p)) if self.sheet in (None, s)]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        yield from cell_batches(partition.path, _content(partition.path), partition.sheet)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: object) -> WorkbookReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
