"""Operators over tables of mail; each takes and returns DataFrames."""
