"""Views over a collection's logs: pure functions from DataFrames to DataFrames."""
