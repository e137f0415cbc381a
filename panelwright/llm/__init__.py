"""Operators for preparing training corpora at cluster scale. Nothing else in the library imports them."""
