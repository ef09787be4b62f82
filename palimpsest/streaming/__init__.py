"""Incremental variants of the batch operators."""
