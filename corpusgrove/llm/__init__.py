"""Operators of a training-data pipeline over a ``documents`` table.

One module per operator; ``queries`` registers them. Nothing outside this
subpackage imports it.
"""
