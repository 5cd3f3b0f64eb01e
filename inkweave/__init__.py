"""Graph link prediction and record analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
