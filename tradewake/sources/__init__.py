"""Scans, sinks and keyed ingest."""
