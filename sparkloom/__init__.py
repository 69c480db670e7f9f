"""Operators for building, cleaning and evaluating question-answer corpora on Spark."""
