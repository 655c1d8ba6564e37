"""Errors a caller can act on."""

from __future__ import annotations


class RuleError(ValueError):
    """A rule, target list or request that cannot be run as given."""


class SourceError(ValueError):
    """A source that cannot be read as given."""
