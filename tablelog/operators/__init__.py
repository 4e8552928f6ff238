"""Writing operators, and joins that Spark has no single operator for."""
