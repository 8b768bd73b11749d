"""paperloom operators package."""
