"""Rules over streaming tables."""
