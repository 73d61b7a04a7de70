"""Errors that reach a client; each names its HTTP status."""

from __future__ import annotations


class ServiceError(Exception):
    status = 500
    retry = False

    def __init__(self, message: str) -> None:
        super().__init__(message)
        self.message = message


class AdqlSyntaxError(ServiceError):
    status = 400

    def __init__(self, message: str, position: int | None = None) -> None:
        super().__init__(message if position is None else f"{message} (at character {position})")
        self.position = position


class UnsupportedAdqlError(ServiceError):
    """Well-formed, but names a construct that is not provided."""

    status = 400


class InvalidParameterError(ServiceError):
    status = 400

    def __init__(self, name: str, reason: str) -> None:
        super().__init__(f"Invalid {name}: {reason}")
        self.parameter = name


class UnsupportedFormatError(ServiceError):
    status = 400

    def __init__(self, asked: str, known: list[str]) -> None:
        super().__init__(f"Unsupported response format '{asked}'. Supported: {', '.join(known)}.")


def _hint(names: list[str]) -> str:
    return f" Did you mean: {', '.join(names)}?" if names else ""


class UnknownTableError(ServiceError):
    status = 400

    def __init__(self, name: str, close_matches: list[str] | None = None) -> None:
        self.name, self.close_matches = name, close_matches or []
        super().__init__(f"Unknown table '{name}'.{_hint(self.close_matches)}")


class UnknownColumnError(ServiceError):
    status = 400

    def __init__(self, name: str, table: str | None = None, close_matches: list[str] | None = None) -> None:
        self.name, self.table, self.close_matches = name, table, close_matches or []
        where = f" on table '{table}'" if table else ""
        super().__init__(f"Unknown column '{name}'{where}.{_hint(self.close_matches)}")


class QueryFailedError(ServiceError):
    """The engine refused or failed a query that passed the gate."""

    status = 400


class SourceUnavailableError(ServiceError):
    status = 503
    retry = True


class QueryTimeoutError(ServiceError):
    status = 408

    def __init__(self, elapsed: float, limit: float) -> None:
        super().__init__(f"Query exceeded the {limit:g} s limit after {elapsed:.1f} s.")


class ResourceLimitError(ServiceError):
    status = 429
    retry = True


class UploadTooLargeError(ServiceError):
    status = 413

    def __init__(self, limit_mb: int) -> None:
        super().__init__(f"Upload exceeds the {limit_mb} MB limit.")


class UnauthorizedError(ServiceError):
    status = 401


class ServiceExpiredError(ServiceError):
    status = 503


class CutoutNotSupportedError(ServiceError):
    status = 501


class DiscoveryError(ServiceError):
    """One file cannot be read; collected, never fatal."""

    status = 400
