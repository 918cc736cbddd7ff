"""Errors raised on the driver while a plan is being built."""

from __future__ import annotations


class AnalyticsError(ValueError):
    """Base class; ``code`` is the stable machine-readable reason."""

    code = "ANALYTICS_ERROR"


class MissingSharedFolder(AnalyticsError):
    code = "MissingSharedFolder"


class InvalidRange(AnalyticsError):
    code = "InvalidRange"


class EmptyInput(AnalyticsError):
    code = "EmptyInput"


class MissingNetworkColumn(AnalyticsError):
    code = "MissingNetworkColumn"


class InvalidFields(AnalyticsError):
    code = "INVALID_FIELDS"

    def __init__(self, invalid: list[str], allowed: list[str]):
        self.invalid = invalid
        self.allowed = allowed
        super().__init__(f"invalid fields {invalid}; allowed fields are {allowed}")


class InvalidCursor(AnalyticsError):
    code = "INVALID_CURSOR"


class BadEvent(AnalyticsError):
    """Raised by the strict event writer when a batch holds an undecodable event."""

    code = "BadEvent"
