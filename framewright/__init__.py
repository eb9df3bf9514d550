"""DataFrame and Structured Streaming operators for frame, message, session and detection data."""

__version__ = "0.1.0"
