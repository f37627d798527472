"""Point sets."""
