"""Source-code analytics on Spark: scans, lexical facts, inference rules and reports as DataFrames."""
