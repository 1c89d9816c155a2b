"""Governance of declared lakehouse tables, computed with Spark DataFrames."""
