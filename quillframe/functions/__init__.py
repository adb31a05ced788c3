"""Column functions: casts, null rules, bins, truncation of timestamps."""
