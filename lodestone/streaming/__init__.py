"""Structured Streaming over event tables. The evidence dataflows are batch; this is an extension."""
