"""Bounded runs of Structured Streaming."""
