"""Code, document and repository analytics as plain functions from DataFrames to DataFrames."""
