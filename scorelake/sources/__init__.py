"""Strict case ingestion."""
