"""Frames, series, groups and the operators on them."""
