"""Column expressions on texts, vectors and dates."""
