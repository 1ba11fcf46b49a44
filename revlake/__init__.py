"""A Spark-first engine for versioned key-value data: an append-only revision log read through DataFrames."""
