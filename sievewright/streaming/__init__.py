"""Micro-batch checking with Structured Streaming."""
