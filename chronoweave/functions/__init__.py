"""Column expressions and parsers that stay inside the JVM."""
