"""Where documents come from and indexes are kept."""
