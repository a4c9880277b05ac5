"""Relational operators of the document engine: DataFrame in, DataFrame out."""
