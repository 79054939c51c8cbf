"""Column expressions: every function here returns a built-in Spark expression."""
