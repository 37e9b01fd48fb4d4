"""cardloom: identity-card record analytics as declarative Spark DataFrame plans."""
