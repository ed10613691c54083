"""Column expressions: parsing, time parts and rates. All of them run inside the JVM."""
