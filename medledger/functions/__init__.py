"""Column expressions (parsing, ids, time of day) used by the operators."""
