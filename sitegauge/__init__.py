"""sitegauge: rank locations from mixed evidence with Spark DataFrames."""

__version__ = "0.1.0"
