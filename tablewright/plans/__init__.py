"""Declarative step specs, runs, lineage and reports."""
