"""Operators for large-scale training data: lazy DataFrame work on documents, pages and vectors."""
