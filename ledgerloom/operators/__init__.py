"""Operators: ``sales`` DataFrame in, result DataFrame out."""
