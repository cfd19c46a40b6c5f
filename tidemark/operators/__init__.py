"""Operators over DataFrames: intervals, tables, sequences, statistics, motifs."""
