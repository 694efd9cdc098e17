"""Operators for preparing training data and matching records without keys. Nothing else in the library imports this package."""
