"""Training-data pipeline operators (token counts, dedup, PII, archives, ...).

Nothing else in the library imports this subpackage; ``queries`` and
``corpus_pipeline`` are its only entry points.
"""
