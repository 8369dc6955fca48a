"""Stateful operators and Structured Streaming versions of the event queries."""
