"""Operators on bags of terms, corpora, indexes and hits."""
