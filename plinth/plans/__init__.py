"""Query plans: filters and metrics over one scan, and their parameters."""
