"""sources of the graph-pattern engine."""
