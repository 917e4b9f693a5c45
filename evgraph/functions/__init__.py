"""Column expressions: keys, years, types, weights, ids and scores."""
