"""Errors, with the public name and number of each log error."""

from __future__ import annotations

# The names of log errors; the place in the list is the number.
LOG_ERRORS = (
    "UnknownError FFIError ArrowError EngineDataTypeError ExtractError GenericError IOErrorError ParquetError "
    "ObjectStoreError ObjectStorePathError ReqwestError FileNotFoundError MissingColumnError UnexpectedColumnTypeError "
    "MissingDataError MissingVersionError DeletionVectorError InvalidUrlError MalformedJsonError MissingMetadataError "
    "MissingProtocolError InvalidProtocolError MissingMetadataAndProtocolError ParseError JoinFailureError Utf8Error "
    "ParseIntError InvalidColumnMappingModeError InvalidTableLocationError InvalidDecimalError InvalidStructDataError "
    "InternalError InvalidExpression InvalidLogPath FileAlreadyExists UnsupportedError ParseIntervalError "
    "ChangeDataFeedUnsupported ChangeDataFeedIncompatibleSchema InvalidCheckpoint LiteralExpressionTransformError "
    "CheckpointWriteError SchemaError"
).split()


class TableLogError(Exception):
    """Base of all errors of this package."""


class LogError(TableLogError):
    """An error about the log, named and numbered."""

    def __init__(self, name: str, message: str):
        self.name, self.code = name, LOG_ERRORS.index(name)
        super().__init__(f"{name} ({self.code}): {message}")


class CommitConflict(TableLogError):
    """Another writer took the version."""

    def __init__(self, version: int):
        self.version = version
        super().__init__(f"commit conflict at version {version}")


class TransactionError(TableLogError):
    """A transaction can't go on."""


class ConstraintError(TableLogError):
    """Rows break a declared constraint."""


class CatalogError(TableLogError):
    """No such table, or a table can't be used as asked."""


class InvalidInput(TableLogError):
    """A parameter has no valid value."""


class Unsupported(TableLogError):
    """A statement or feature that tables of this kind don't offer."""
