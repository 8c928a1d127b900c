"""Operators that are more than one column expression."""
