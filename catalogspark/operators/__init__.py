"""DataFrame operators. Each takes and returns DataFrames; dates, viewers and limits are parameters."""
