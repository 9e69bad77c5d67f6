"""Composite dataflows over evidence, topics, arguments, submissions and classes."""
