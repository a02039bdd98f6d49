"""Readers, request batches and sinks."""
