"""Readers and writers for recordings, annotations, catalogues and results."""
