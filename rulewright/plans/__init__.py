"""Whole runs, from source to ledger row."""
