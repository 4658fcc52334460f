"""Operators for training data: ten operators on documents and conversations, and their queries.

Nothing outside this subpackage imports it.
"""
