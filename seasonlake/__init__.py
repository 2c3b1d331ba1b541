"""Season analytics on Spark: entity-by-season operators built on DataFrames."""
