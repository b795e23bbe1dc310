"""Operators of a training-data pipeline, their queries and their SQL counterparts.

Nothing else in the library imports this subpackage.
"""
