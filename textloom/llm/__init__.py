"""Operators for large training-text pipelines, one module each.

Nothing outside this subpackage imports it.
"""
