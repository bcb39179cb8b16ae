"""Readers and the bindings of plain tables to note timelines."""
