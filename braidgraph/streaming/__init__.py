"""streaming of the graph-pattern engine."""
