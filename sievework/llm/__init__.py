"""Operators for building training data: filters, deduplication, language and
quality models, token counts, packing and benchmark decontamination.

Nothing else in the library imports this subpackage.
"""
