"""Operators of a training-data pipeline over the ``documents`` and ``pages``
tables.  Nothing else in the library imports this subpackage; its registered
queries are collected in ``transitlake.llm.queries``."""
