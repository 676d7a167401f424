"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage, and it may be removed as a
whole.  Every module keeps a general operator; ``queries`` holds the thin
``opN_<name>`` queries that derive digest columns from the operators' outputs.
"""
