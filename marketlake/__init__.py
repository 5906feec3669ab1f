"""Batch and streaming market-data operators written as Spark DataFrame code."""
