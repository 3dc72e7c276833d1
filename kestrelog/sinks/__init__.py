"""Appending tables."""
