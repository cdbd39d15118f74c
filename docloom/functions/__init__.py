"""Scalar functions: formulas, numbers and the Columns made of them."""
