"""Readers and writers for catalog, pixel, AOI and result tables."""
