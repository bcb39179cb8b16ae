"""Joins, windows, alignments and rules as DataFrame functions."""
