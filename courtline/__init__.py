"""Contest analytics as Spark DataFrame operators."""
