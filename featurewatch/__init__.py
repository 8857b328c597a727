"""featurewatch: feature tables, risk models and drift monitoring on Spark."""

__version__ = "0.1.0"
