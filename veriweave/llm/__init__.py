"""Operators for preparing language-model training data.

Nothing outside this package imports it. Every operator takes DataFrames and returns
DataFrames; ``queries`` holds the registered queries.
"""
