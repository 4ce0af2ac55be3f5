"""Readers, sinks, staging and the views derived from the star-schema tables."""
