"""Operators of a training-data pipeline over tables of documents and pages.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; the thin queries over the driver's tables are in ``queries.py``."""
