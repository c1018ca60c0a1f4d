"""deckframe: finite-element decks and results as Spark DataFrames."""
