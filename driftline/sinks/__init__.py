"""Writers for event frames."""
