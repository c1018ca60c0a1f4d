"""Readers and writers of decks and binary results."""
