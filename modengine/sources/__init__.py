"""Readers and writers of comment tables, metric results and models."""
