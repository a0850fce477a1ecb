"""Pairwise similarity analytics on Spark."""
