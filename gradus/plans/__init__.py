"""Whole reports: what is computed together, and how it is written."""
