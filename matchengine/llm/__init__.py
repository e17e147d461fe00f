"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; it can be removed as a
whole.  Each module holds one operator with its own general interface, and
``queries`` derives the digest columns of the registered queries from them.
"""
