"""Relations of the pipeline, each a function from DataFrames to a DataFrame."""
