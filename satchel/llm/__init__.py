"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage; ``queries`` holds the thin
query wrappers that ``__spark_entry__`` registers when the subpackage exists.
"""
