"""Parcela: feature tables, filters, edits and a file geodatabase source on Spark DataFrames."""
