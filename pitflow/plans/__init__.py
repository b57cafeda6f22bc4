"""Operators put together into whole queries."""
