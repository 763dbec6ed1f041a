"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; ``queries.py`` registers the
``opN_*`` queries and ``__spark_entry__.py`` adds them when the package is
present.
"""
