"""Document extraction, conformity and training-data analytics on Spark."""
