"""Operators for preparing large training collections.

Nothing outside this subpackage imports it.
"""
