"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with its own
general interface; ``queries`` holds the thin ``opN_<name>`` queries over the shared tables.
"""
