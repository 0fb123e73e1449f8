"""Fact queries and consistency analytics on Spark."""
