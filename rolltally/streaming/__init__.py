"""Structured Streaming versions of the vote, metric, dedup and log jobs."""
