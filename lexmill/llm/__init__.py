"""Operators for preparing training text: deduplication, extraction, decontamination,
quality scoring, token counting, packing, licence scans and surrogate generation.

Nothing else in the library imports this subpackage.
"""
