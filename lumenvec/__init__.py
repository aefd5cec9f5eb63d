"""Spark-first analytics over embedding vectors and the text, page and event data around them."""
