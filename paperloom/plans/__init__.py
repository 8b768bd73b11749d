"""paperloom plans package."""
