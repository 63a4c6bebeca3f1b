"""lexiforge: text search, query correction and corpus preparation on Spark."""
