"""Errors of the public API."""


class ColumnDoesNotExist(KeyError):
    """A column that the frame has not."""


class InvalidOperation(TypeError):
    """An operation that the frame or column does not take."""


class ColumnOverlap(ValueError):
    """Both sides of a join have a column, and the merge policy forbids it."""


class IgnoreMessage(Exception):
    """Raised by a deserializer for a message that is to be left out."""
