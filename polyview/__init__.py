"""Probabilistic analytics of one wide table on Spark: cross-categorization, queries, fitting."""
