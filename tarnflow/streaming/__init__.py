"""Structured Streaming forms of the operators whose batch forms live in ``tarnflow.operators``."""
