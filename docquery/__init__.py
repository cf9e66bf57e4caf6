"""docquery: document search, aggregation and data-preparation jobs on Spark DataFrames."""
