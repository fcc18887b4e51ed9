"""Operators as functions from DataFrames to DataFrames; ``tarnflow.flow`` strings them together."""
