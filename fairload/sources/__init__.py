"""Readers, writers, schemas and the input mapping."""
