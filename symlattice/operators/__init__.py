"""operators of the interface-graph engine."""
