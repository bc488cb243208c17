"""Property graphs, road networks and corpus processing as PySpark DataFrames."""
