"""From statements to DataFrames."""
