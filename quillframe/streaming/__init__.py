"""Batch operators as Structured Streaming: tumbling buckets with a watermark, and first rows by key."""
