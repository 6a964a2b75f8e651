"""tidelog: versioned key-value logs as DataFrames, at any size."""
