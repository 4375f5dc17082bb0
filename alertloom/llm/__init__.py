"""Operators for preparing language-model training corpora.

Each module holds one operator; ``queries`` registers them. Nothing outside this
subpackage imports it.
"""
