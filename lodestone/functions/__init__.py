"""Column functions and plan-time arithmetic."""
