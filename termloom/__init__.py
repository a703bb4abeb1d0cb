"""Lexical search and text statistics on Spark."""
