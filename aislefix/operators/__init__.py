"""The steps of the method; each takes and returns DataFrames."""
