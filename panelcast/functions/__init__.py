"""Stateless column expressions: usable on batch and streaming DataFrames alike."""
