"""Operators over matrix tables and distribution tables."""
