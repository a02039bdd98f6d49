"""Streaming views over lookups, refusals and renders."""
