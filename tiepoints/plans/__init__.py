"""Operators put together, and the registered queries with their SQL."""
