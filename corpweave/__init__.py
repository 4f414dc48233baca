"""Corpus analytics as plain DataFrame functions on Spark."""
