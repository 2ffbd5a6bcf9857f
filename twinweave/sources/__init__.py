"""Readers and writers for articles, Turtle, graph JSON and sessions."""
