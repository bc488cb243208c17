"""Whole jobs, and how their intermediate results are kept."""
