"""Column functions: every rule here is a native Spark expression, no Python per row."""
