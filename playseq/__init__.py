"""Repair, checking and summaries of keyed, ordered event sequences on Spark."""
