"""Scalar, vector and table-valued functions as Column expressions."""
