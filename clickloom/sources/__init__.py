"""Readers, writers and the impressions table."""
