"""Operators for preparing language-model training data at cluster scale.

Nothing outside this package imports it.
"""
