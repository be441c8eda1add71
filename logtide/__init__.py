"""Log-table lifecycle operators on Spark DataFrames."""
