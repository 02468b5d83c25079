"""Spark jobs for regional business statistics and study search."""
