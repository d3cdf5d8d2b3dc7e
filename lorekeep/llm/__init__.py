"""Operators for training-data pipelines; nothing else in lorekeep imports this subpackage."""
