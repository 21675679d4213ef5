"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only where it can
be imported. Every operator takes DataFrames and returns DataFrames; ``queries.py`` holds the thin
``opN_*`` queries that derive the contract's columns from the operators' outputs.
"""
