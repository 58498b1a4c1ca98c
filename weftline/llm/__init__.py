"""Operators for preparing training data: ten methods over documents, pages and conversations.

Nothing else in the library imports this subpackage.
"""
