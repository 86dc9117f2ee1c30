"""Filled-down formulas: runs of cells in a column whose formulas are the same relative to their own cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FormulaError
from ..plans.syntax import relative_form


def uniform_columns(cells: DataFrame, least: int = 2) -> DataFrame:
    """path, sheet, col, first_row, last_row, form, formula (of the first row) of each run of at least ``least`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = []
            for formula, col, row in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    forms.append(relative_form(formula, col, row))
                except FormulaError:
                    forms.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forms, pa.string())], names=[*b.schema.names, "form"])

    given = cells.where("formula IS NOT NULL").select("path", "sheet", "row", "col", "formula")
    formed = given.mapInArrow(run, "path string, sheet string, row int, col int, formula string, form string").where("form IS NOT NULL")
    # within a run, row minus rank is constant
    w = Window.partitionBy("path", "sheet", "col", "form").orderBy("row")
    runs = formed.withColumn("__run", F.col("row") - F.row_number().over(w)).groupBy("path", "sheet", "col", "form", "__run")
    out = runs.agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min_by("formula", "row").alias("formula"))
    return out.where(F.col("last_row") - F.col("first_row") + 1 >= least).select("path", "sheet", "col", "first_row", "last_row", "form", "formula")
