"""Incremental maintenance of an index from a stream."""
