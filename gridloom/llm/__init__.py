"""Operators of a training-data pipeline, one module each; nothing outside this subpackage imports it."""
