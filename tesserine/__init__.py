"""Property-graph analytics on Spark: pattern queries, vector and text search, streams."""
