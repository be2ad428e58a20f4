"""Candidate joins, top-k, aggregates and diagnostics."""
