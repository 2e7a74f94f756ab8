"""Operators of record linkage: DataFrame in, DataFrame out."""
