"""The one error type raised by input checks."""


class InputError(ValueError):
    """Raised when a table, column or file does not meet an operator's contract."""
