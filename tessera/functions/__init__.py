"""Scalar functions: column expressions over text, and driver-side understanding of a query."""
