"""Whole clustering pipelines."""
