"""Relational, spatial and graph operators over DataFrames."""
