"""Datasets in, reports out."""
