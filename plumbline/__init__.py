"""Screening of machine-learning data pipelines as Spark jobs over tracked DataFrames."""
