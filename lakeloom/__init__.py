"""A Spark-first warehouse pipeline and analytics engine."""
