"""spindrift: a PySpark-native engine for web text indexing, full-text search and crawl scheduling."""
