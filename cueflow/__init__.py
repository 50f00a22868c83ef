"""cueflow: timed-text analytics on PySpark DataFrames."""
