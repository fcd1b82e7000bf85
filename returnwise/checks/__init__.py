"""Data-integrity checks: each returns the offending rows, none when the data is sound."""
