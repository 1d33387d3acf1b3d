"""fleetlens: profiling, cleaning, feature, model, metric and log-analytics
operators over Spark DataFrames, generic in their column names."""

__version__ = "0.1.0"
