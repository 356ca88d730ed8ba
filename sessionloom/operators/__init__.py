"""DataFrame operators: each takes DataFrames and typed parameters and returns a DataFrame."""
