"""plans of the graph-pattern engine."""
