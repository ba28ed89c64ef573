"""Scans, parsers, stores and model connectors."""
