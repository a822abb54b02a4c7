"""Spark-first library of operators for decision-record datasets."""
