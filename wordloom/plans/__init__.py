"""wordloom plans."""
