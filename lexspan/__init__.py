"""Spark jobs for reviewing large document collections as tables."""
