"""quarry: hybrid retrieval and corpus preparation on PySpark DataFrames."""
