"""Column expressions; every one runs inside the JVM."""
