"""Column expressions: each function takes and returns Spark columns, and runs wholly in the JVM."""
