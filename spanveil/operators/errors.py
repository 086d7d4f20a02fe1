"""Errors of configuration. Errors of data are a status column; no message holds text or what was matched in it."""

from __future__ import annotations


class GuardError(ValueError):
    """Base of all."""


class ConfigError(GuardError):
    """A detector, policy, prefix or key that can't be used; the reason never holds caller text."""

    def __init__(self, reason: str):
        super().__init__(f"invalid configuration: {reason}")
        self.reason = reason


class SuiteError(GuardError):
    """A suite, manifest, mapping or threshold file that breaks its schema."""
