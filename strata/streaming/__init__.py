"""Structured Streaming layers: bronze append ingest, silver keep-latest."""
