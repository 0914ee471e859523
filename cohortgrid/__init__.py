"""Subgroup evidence on Spark DataFrames: cleaning, statistics, ranking, text checks and gates."""
