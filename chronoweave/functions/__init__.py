"""Column functions of the event-graph engine."""
