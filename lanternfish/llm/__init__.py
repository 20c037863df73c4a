"""Training-data operators: extraction, deduplication, decontamination, scoring and tokenisation.

Nothing else in the library imports this subpackage.
"""
