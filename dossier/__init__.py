"""Decision records as DataFrames: quotes, units, edges, staleness, retrieval, judging, evidence, review, scoring."""
