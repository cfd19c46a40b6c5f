"""Operators for preparing training text at scale.

Nothing outside this folder imports it, and it imports nothing from the rest of the library.
"""
