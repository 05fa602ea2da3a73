"""The engine's errors."""


class MillraceError(Exception):
    """Base of all."""


class LoadError(MillraceError):
    """A source can't be read."""


class TableError(MillraceError):
    """A table is not usable: no rows, no columns, or not a table."""


class RepairError(MillraceError):
    """A repair can't be carried out."""


class ExportError(MillraceError):
    """A table must not be exported."""


class ProviderError(MillraceError):
    """A language-model provider failed."""


class PlanError(MillraceError):
    """A proposed plan is not valid."""
