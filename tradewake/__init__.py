"""Trade analytics on Spark: labels, point-in-time features, segments, models and backtests."""

__version__ = "0.1.0"
