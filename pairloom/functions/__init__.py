"""Column expressions: no Python UDFs, everything stays in the JVM."""
