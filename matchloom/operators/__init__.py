"""Linkage operators: DataFrame in, DataFrame out."""
