"""Tables and files as DataFrames."""
