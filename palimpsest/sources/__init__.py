"""Sources of segments and sinks of results."""
