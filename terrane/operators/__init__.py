"""Relational operators on cells, graphs, models and metadata."""
