"""Versioned, tenant-scoped record collections on Spark, and a toolbox for training-data pipelines."""
