"""Labelled tables on Spark."""
