"""Column builders: JVM-side expressions, and Arrow UDFs only where no expression exists."""
