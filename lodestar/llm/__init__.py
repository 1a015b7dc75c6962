"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames and selects only the columns
it names, so extra columns of its input never clash with its own.
"""
