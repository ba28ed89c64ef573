"""Whole plans: indexing, retrieval, prompts."""
