"""Queries over the star-schema tables that exercise the operators, and their SQL."""
