"""wordloom functions."""
