"""Joins, rollups and row rules over DataFrames."""
