"""Document analytics on Spark: every operator is a DataFrame-to-DataFrame function."""

__version__ = "0.1.0"
