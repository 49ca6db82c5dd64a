"""Column-in, column-out expressions; all built from Spark SQL functions."""
