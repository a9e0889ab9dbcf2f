"""riskweave: risk, customer-value and answer-evaluation analytics on Spark DataFrames."""

__version__ = "0.1.0"
