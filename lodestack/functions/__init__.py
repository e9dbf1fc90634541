"""Part of lodestack."""
