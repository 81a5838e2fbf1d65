"""Reading deliveries, code lists, rules and name lists, and writing exports."""
