"""Structured Streaming: the batch operators inside micro-batches."""
