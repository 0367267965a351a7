"""Column expressions that the operators are built from; all of them stay in the JVM."""
