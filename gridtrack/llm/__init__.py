"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  The queries that apply the operators
to the driver's tables are in :mod:`gridtrack.llm.queries`.
"""
