"""Whole query plans: the session of open datasets, and the registered queries."""
