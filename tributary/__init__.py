"""A laboratory for relational joins and join ordering on Spark."""
