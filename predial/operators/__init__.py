"""Listing analytics: operators."""
