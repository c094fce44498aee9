"""Market data and training-data work as plain Spark DataFrame functions."""
