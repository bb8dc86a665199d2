"""Column expressions: text, identities, geography, vectors. All of them stay in the JVM."""
