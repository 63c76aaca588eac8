"""Readers, writers and generators: lines, bytes, CSV, Parquet, JSON, archives, tensors, geometry, value serialisation."""
