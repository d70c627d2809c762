"""Filters, geometry and conversions as Column expressions."""
