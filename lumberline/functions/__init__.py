"""Column expressions: text in, text out, all evaluated in the JVM."""
