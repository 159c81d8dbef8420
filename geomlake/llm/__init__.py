"""Operators of a training-data pipeline over document, vector and token tables.

The package stands alone: nothing else in the library imports it.
"""
