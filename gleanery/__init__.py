"""Gleanery: content-watch analytics over dated, sourced, multi-label articles, on PySpark."""
