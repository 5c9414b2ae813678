"""Readers that turn stored inputs into plain DataFrames."""
