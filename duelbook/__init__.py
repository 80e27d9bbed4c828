"""Point-in-time analytics for head-to-head contests, as Spark DataFrame operators."""

__version__ = "0.1.0"
