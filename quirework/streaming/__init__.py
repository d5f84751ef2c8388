"""Keyed-state operators, each with a batch twin."""
