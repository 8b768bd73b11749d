"""paperloom streaming package."""
