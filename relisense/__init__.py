"""Signal-reliability analytics as plain Spark DataFrame jobs."""
