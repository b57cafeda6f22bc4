"""Readers, wire formats and keyed tables."""
