"""Operators for training-data pipelines: ten over the text tables, each in a module of its own."""
