"""Whole jobs put together from operators, and the registered queries."""
