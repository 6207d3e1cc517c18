"""Photo-catalog analytics as Spark DataFrame operators."""
