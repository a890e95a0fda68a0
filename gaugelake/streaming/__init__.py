"""Structured Streaming: an addition, none of the batch operators needs it."""
