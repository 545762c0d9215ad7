"""Performance diagnosis on Spark: from low-level event logs to the cause of a slowdown."""

__version__ = "0.1.0"
