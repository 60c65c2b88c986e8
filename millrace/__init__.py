"""Corpus analytics on Spark: sources, profiles, rules, splits, tokens, windows, run metrics and planning as DataFrame operations."""
