"""Listing analytics: streaming."""
