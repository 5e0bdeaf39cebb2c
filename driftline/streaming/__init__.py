"""Stateful processors that do in streams what batch plans do in tables."""
