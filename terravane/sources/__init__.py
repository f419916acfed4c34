"""Readers and writers of Parquet with geometry metadata and of GeoJSON."""
