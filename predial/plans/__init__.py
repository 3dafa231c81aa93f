"""Listing analytics: plans."""
