"""Operators for preparing text of language models.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it can be imported.
"""
