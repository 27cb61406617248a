"""Paired-artifact analytics on Spark."""
