"""paperloom sinks package."""
