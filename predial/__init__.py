"""Listing analytics expressed as Spark DataFrame jobs."""
