"""Hybrid document search and text analytics on Spark."""
