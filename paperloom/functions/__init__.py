"""paperloom functions package."""
