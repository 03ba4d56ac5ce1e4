"""Errors of configuration, input and contracts."""


class ConfigurationError(ValueError):
    """The configuration is invalid; raised before any plan is built."""

    exit_code = 2


class InputValidationError(ValueError):
    """An input text or range is invalid."""


class ContractValidationError(ValueError):
    """A finding breaks its contract."""
