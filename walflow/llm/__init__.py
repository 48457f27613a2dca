"""Operators for training-data pipelines. Nothing else in walflow imports this package."""
