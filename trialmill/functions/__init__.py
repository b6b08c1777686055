"""Column expressions on signals, hashes of keys, exact quantiles, filter design."""
