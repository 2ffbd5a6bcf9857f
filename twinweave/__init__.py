"""Twinweave: knowledge-graph construction and alignment on Spark DataFrames."""
