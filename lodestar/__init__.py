"""A Spark-first engine for semantic search over paper records and for corpus analytics."""
