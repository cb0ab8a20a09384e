"""Spark-first analytics over labelled tables and series; see README.md."""
