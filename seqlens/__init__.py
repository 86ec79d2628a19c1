"""Spark-first analytics over sequence, alignment, graph, coverage and taxonomy relations."""
