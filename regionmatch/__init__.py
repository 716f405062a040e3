"""Query-by-example region matching and evaluation on large rasters, on Spark DataFrames."""
