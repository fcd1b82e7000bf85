"""Column expressions and the small numeric helpers Spark SQL lacks."""
