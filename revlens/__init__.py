"""Revision-history analytics on PySpark."""
