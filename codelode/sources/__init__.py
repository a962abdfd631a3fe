"""Readers for corpora, tables, change logs and key-value files."""
