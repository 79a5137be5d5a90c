"""Operators of a training-data pipeline over large text, vector and page tables."""
