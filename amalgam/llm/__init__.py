"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; :mod:`amalgam.llm.registry` lists its queries.
"""
