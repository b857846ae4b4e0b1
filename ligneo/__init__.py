"""Fixed-width hospital-activity files as Spark DataFrames."""
