"""Operators for preparing training data: one module per operator, thin queries in `queries`.

Nothing else in the package imports from here.
"""
