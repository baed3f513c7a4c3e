"""Operators of a training-data pipeline, each a Spark job; ``queries`` registers them."""
