"""Compositions of operators into registered queries."""
