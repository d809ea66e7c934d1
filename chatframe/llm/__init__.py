"""Operators for preparing training corpora, as Spark DataFrame functions.

Nothing else in the library imports this subpackage.
"""
