"""Spark jobs that evaluate and diagnose retrieval-augmented question answering."""
