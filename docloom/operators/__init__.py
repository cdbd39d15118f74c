"""Operators over sets of documents."""
