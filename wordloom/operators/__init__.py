"""wordloom operators."""
