"""Readers that turn files and API dumps into DataFrames."""
