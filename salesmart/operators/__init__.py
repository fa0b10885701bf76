"""Table-to-table steps; each takes and returns DataFrames."""
