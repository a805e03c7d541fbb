"""Whole plans built from the operators, and the queries the driver runs with their SQL."""
