"""Tilings of a time axis as streaming windows."""
