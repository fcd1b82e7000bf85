"""Scores and diagnostics over the scored relation, as DataFrames."""
