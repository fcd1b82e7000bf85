"""Customer value analytics on Spark: windows, occasions, models, scores and checks."""

from returnwise.settings import Settings

__all__ = ["Settings"]
