"""Relational operators: index, set queries, ranking, evaluation, versions of rows, skewed groups."""
