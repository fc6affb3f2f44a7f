"""Content-feed analytics as Spark DataFrame and Structured Streaming operators."""
