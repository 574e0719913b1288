"""Readers, writers and samplers."""
