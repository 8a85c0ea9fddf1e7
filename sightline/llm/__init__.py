"""Operators that prepare training data for language models.

Nothing else in ``sightline`` imports this subpackage; ``queries`` registers its operators.
"""
