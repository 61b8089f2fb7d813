"""Antipode: paired-entity differential analytics on Apache Spark DataFrames."""
