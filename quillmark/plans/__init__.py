"""The named queries, by family."""
