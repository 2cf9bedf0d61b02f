"""wordloom sources."""
