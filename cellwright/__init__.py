"""cellwright: a spreadsheet-formula and workbook engine expressed in PySpark."""
