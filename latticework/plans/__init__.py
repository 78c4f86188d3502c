"""Configured pipelines that put the operators together."""
