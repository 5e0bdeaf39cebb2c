"""Readers that give event frames."""
