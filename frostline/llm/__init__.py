"""Operators that turn the texts of the road feeds into training data. Nothing else in the library imports this folder."""
