"""Training-data operators: dedup, quality, tokenising, scoring, search, packing, spelling and conversation repair.

Nothing else in the package imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` derives the registered
``opN_*`` digests from the operators' real outputs.
"""
