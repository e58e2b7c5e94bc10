"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns a DataFrame; ``queries`` holds the registered entry points.
"""
