"""Pipelines composed of the operators, and the query catalogue."""
