"""Whole problems, put together from operators."""
