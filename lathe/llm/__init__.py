"""Operators for building training data from text tables.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
