"""Error codes and the mapping of Spark's exceptions to them."""

from __future__ import annotations

from enum import IntEnum


class ErrorCode(IntEnum):
    OK = 0
    SYSTEM = 1
    OVERFLOW = 2
    TRUNCATED = 3
    UNSUPPORTED = 4
    NETWORK = 5
    RANGE = 6
    SOURCE = 7
    DIVISION = 8
    FILESYSTEM = 9
    KILLED = 10

    @property
    def message(self) -> str:
        return _MESSAGES[self]


_MESSAGES = {
    ErrorCode.OK: "no error",
    ErrorCode.SYSTEM: "the runtime failed",
    ErrorCode.OVERFLOW: "a value left the range of its type",
    ErrorCode.TRUNCATED: "a value had to be cut",
    ErrorCode.UNSUPPORTED: "a type or function isn't supported here",
    ErrorCode.NETWORK: "a connection failed",
    ErrorCode.RANGE: "an argument is outside its range",
    ErrorCode.SOURCE: "a source refused the query",
    ErrorCode.DIVISION: "a division by zero",
    ErrorCode.FILESYSTEM: "a file couldn't be read or written",
    ErrorCode.KILLED: "the job was killed",
}


class EngineError(Exception):
    """An error with its code; str() has the details."""

    def __init__(self, code: ErrorCode, detail: str = ""):
        super().__init__(f"{code.name}: {detail or code.message}")
        self.code, self.detail = code, detail


#: Error classes of Spark, by what their condition or text contains.
_SIGNS = (
    (ErrorCode.KILLED, ("cancelled", "canceled", "OPERATION_CANCELED", "JOB_CANCELLED")),
    (ErrorCode.OVERFLOW, ("ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "CAST_OVERFLOW", "DOUBLE_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW")),
    (ErrorCode.DIVISION, ("DIVIDE_BY_ZERO",)),
    (ErrorCode.RANGE, ("CAST_INVALID_INPUT", "INVALID_ARRAY_INDEX")),
    (ErrorCode.SOURCE, ("TABLE_OR_VIEW_NOT_FOUND", "PARSE_SYNTAX_ERROR", "UNRESOLVED_COLUMN", "SQLException")),
    (ErrorCode.FILESYSTEM, ("PATH_NOT_FOUND", "FileNotFoundException", "FAILED_READ_FILE", "No space left")),
    (ErrorCode.NETWORK, ("ConnectException", "FetchFailed")),
    (ErrorCode.UNSUPPORTED, ("DATATYPE_MISMATCH", "UNSUPPORTED_")),
)


def engine_error(e: BaseException, killed: bool = False) -> EngineError:
    """The engine's error for any exception."""
    if isinstance(e, EngineError):
        return e
    text = str(e)
    if killed:
        return EngineError(ErrorCode.KILLED, text.split("\n")[0])
    for code, signs in _SIGNS:
        if any(s in text for s in signs):
            return EngineError(code, text.split("\n")[0])
    return EngineError(ErrorCode.SYSTEM, text.split("\n")[0])
