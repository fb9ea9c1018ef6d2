"""Sources and sinks of vectors."""
