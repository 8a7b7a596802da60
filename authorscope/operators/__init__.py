"""Rules and aggregates as DataFrame transforms."""
