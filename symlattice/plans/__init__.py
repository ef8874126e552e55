"""plans of the interface-graph engine."""
