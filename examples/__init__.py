"""Complete pipelines over CSV files, each a function of its parameters."""
