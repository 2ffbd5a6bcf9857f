"""Kept empty on purpose: the capability set is batch only (see README)."""
