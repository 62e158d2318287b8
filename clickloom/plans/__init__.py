"""Whole feature recipes and the catalogue of checked queries."""
