"""Readers, fixed dimensions and snapshot tables."""
