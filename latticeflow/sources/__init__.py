"""Readers and writers of catalogue formats."""
