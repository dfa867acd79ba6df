"""Operators of a training-data pipeline over Spark tables. Nothing else in the library imports this subpackage."""
