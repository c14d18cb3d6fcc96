"""Table intelligence on Spark: a DataFrame in, DataFrames of findings out."""
