"""The catalogue of queries over the benchmark tables, each with SQL that gives the same rows."""
