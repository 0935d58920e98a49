"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; its queries are registered by
``cuewise.llm.queries`` and picked up by the driver entry point when present.
"""
