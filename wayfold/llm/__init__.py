"""Operators for building language-model training data.

One module per operator; ``queries`` names them for the entry file.  Nothing
outside this subpackage imports it.
"""
