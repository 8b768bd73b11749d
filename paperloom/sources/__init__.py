"""paperloom sources package."""
