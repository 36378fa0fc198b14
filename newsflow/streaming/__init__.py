"""The five analyses as Structured Streaming jobs."""
