"""Operators on text and corpora for building training data. Nothing else in the library imports this subpackage."""
