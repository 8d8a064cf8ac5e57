"""Operators for building language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general DataFrame interface; ``queries`` registers the fixed queries.
"""
