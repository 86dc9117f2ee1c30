"""Reading workbooks and delimited text into cells, and writing workbooks."""
