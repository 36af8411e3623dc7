"""Feature sources."""
