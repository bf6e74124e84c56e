"""Operators for training-data pipelines. Nothing outside this folder imports it."""
