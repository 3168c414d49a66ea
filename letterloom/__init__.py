"""Letterloom: ingest, segment, search and curate collections of official letters on Spark."""
