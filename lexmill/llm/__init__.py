"""Operators for preparing training text at large scale.

Nothing else in the library imports this subpackage. Each operator lives in a
module of its own with a general interface; ``queries`` holds the thin
``opN_<name>`` queries and their SQL.
"""
