"""The same data steps over unbounded input, by Structured Streaming."""
