"""Whole plans: ingest, search and answering."""
