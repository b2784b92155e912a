"""The three studies as lazy plans, and the registered queries."""
