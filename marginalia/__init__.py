"""Spark library for enriching encyclopedia articles and measuring what they omit."""
