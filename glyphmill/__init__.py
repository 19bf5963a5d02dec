"""Text analytics and data preparation on Spark."""

__version__ = "0.1.0"
