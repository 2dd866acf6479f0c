"""Training-data operators: packing, deduplication, language and quality models, tokens, search, PII.

Nothing else in the library imports this package; ``queries.py`` holds its registered queries.
"""
