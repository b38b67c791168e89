"""The checks themselves: one DataFrame in, one tidy DataFrame out."""
