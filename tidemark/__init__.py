"""A Spark library for timed media segments and for text corpora."""
