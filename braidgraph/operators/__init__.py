"""operators of the graph-pattern engine."""
