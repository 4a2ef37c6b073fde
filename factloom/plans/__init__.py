"""Question planning."""
