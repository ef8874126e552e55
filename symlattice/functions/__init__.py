"""functions of the interface-graph engine."""
