"""Operators over DataFrames; each takes and returns DataFrames and collects nothing that grows."""
