"""tideline: keyed time-series and operational-state analytics on Spark."""

__version__ = "0.1.0"
