"""Corpus assembly, retrieval and record analytics on Spark."""
