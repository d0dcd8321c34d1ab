"""quern: a Spark-native workbench for profiling, cleaning and judging tabular data."""

__version__ = "0.1.0"
