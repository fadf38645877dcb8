"""Column -> Column building blocks. Everything here stays in built-in JVM expressions."""
