"""recollect: self-organising text memories as DataFrames, on PySpark."""
