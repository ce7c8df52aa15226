"""Versioned reports."""
