"""Column expressions: text, vectors, keyed noise. All but private noise run inside the JVM."""
