"""Palimpsest: conversation-history retrieval and text processing on Spark."""
