"""Literature screening on Spark: search, resolve, rank, extract and keep one row per (inputs, article)."""

from litscreen.spec import ReviewSpec

__all__ = ["ReviewSpec"]
