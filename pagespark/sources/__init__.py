"""Readers and writers of sample, corpus and export files."""
