"""News and reader-comment analytics as Spark DataFrame operators."""
