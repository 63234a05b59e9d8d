"""Operators for preparing training text, and their registered queries.

Nothing outside this folder imports it.  Each operator is a function of DataFrames in a
module of its own; :mod:`cuelog.llm.queries` applies them to the given tables.
"""
