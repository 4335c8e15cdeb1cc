"""Operators for preparing language-model training data.

Self-contained: nothing in the rest of the library imports this subpackage.
"""
