"""End-to-end jobs: ingest, benchmark, answer, evaluate, diagnose, export."""
