"""wordloom streaming."""
