"""Code and document retrieval on Spark DataFrames: indexing, hybrid search, graph expansion, prompts, change feeds."""
