"""Parameters that arrive as a stream."""
