"""Compositions of operators that answer a whole request table."""
