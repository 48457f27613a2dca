"""Exceptions, and the reason codes of dead letters."""


class WalflowError(Exception):
    """Base of all errors; `context` adds where it happened."""

    def context(self, where: str) -> "WalflowError":
        return type(self)(f"{where}: {self}")


class ParseError(WalflowError):
    def __init__(self, reason: str, text: str = ""):
        super().__init__(text or reason)
        self.reason = reason


class ConfigError(WalflowError): ...


class SourceError(WalflowError): ...


class ConnectionFailed(SourceError): ...


class AuthError(SourceError): ...


class SinkError(WalflowError): ...


class CheckpointError(WalflowError): ...


REASONS = (
    "empty_message", "unknown_message_type", "buffer_underflow", "missing_null_terminator", "bad_tuple_marker", "bad_tuple_format",
    "unknown_relation", "no_open_transaction", "aborted", "subxact_abort_unresolved", "replaced", "lsn_overflow", "bad_lsn",
)
