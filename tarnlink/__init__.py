"""A Spark-first record-linkage and analytics engine."""
