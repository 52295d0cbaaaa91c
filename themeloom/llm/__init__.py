"""Operators for preparing training text: filters, deduplication, tokenizers, scores and packing.

Nothing else in the library imports this package. Every operator takes and returns DataFrames, names its
columns by parameter, and reads whole texts. Column names an operator adds replace input columns of that name.
"""
