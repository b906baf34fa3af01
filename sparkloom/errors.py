"""Errors that a caller can tell apart."""


class SearchError(Exception):
    """Base of all errors here."""


class QuerySyntaxError(SearchError):
    """A filter expression that doesn't parse."""


class IndexNotFound(SearchError):
    """No index in the given folder, above the working directory or at home."""


class CorruptIndex(SearchError):
    """An index whose tables can't be read."""


class ParseError(SearchError):
    """A file that its reader can't take in."""


class UnsupportedFileType(SearchError):
    """A file of a kind that no reader takes."""
