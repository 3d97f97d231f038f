"""Operators on text and training corpora; nothing else in the library imports this subpackage."""
