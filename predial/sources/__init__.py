"""Listing analytics: sources."""
