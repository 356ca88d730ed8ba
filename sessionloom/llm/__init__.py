"""Operators for preparing training corpora; see the table in the README."""
