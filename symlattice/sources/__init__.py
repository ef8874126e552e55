"""sources of the interface-graph engine."""
