"""Typed failures, each with the process exit code the command line returns."""


class EngineError(Exception):
    """Base of every failure this package raises on purpose."""

    exit_code = 1


class ConfigurationError(EngineError):
    exit_code = 2


class CredentialError(ConfigurationError):
    exit_code = 3


class StorageError(EngineError):
    exit_code = 4


class SearchError(EngineError):
    exit_code = 5


class AcquisitionError(EngineError):
    exit_code = 6


class ExtractionFailure(EngineError):
    exit_code = 7


class ExportFailure(EngineError):
    exit_code = 8
