"""wordloom: document analytics as Spark DataFrame plans."""
