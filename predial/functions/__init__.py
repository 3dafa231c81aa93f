"""Listing analytics: functions."""
