"""Keyed changelog engine on Spark: ordered key/value data with newest-wins reads, kept as levels of sorted Parquet runs."""
