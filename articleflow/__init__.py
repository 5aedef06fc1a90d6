"""Collect, clean, merge, query and report article data as Spark jobs."""
