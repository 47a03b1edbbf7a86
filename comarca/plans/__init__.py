"""Whole jobs: raw registers to model tables, and the driver tables in their roles."""
