"""Relational operators over decks and results."""
