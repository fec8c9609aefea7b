"""Spark-first analytics for labelled URL datasets."""
