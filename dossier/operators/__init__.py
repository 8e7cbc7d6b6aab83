"""DataFrame operators. Each takes DataFrames and returns one (or a tuple that includes its rejects)."""
