"""lorekeep: knowledge-bundle analytics expressed as Spark DataFrames."""
