"""Synthetic cities and agents."""
