"""Quillmark: posting, graph and corpus analytics on Spark."""
