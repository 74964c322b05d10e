"""The one error that a bad query raises."""


class QueryError(ValueError):
    """What is wrong with a query and, where known, the line and column (from 1)."""

    def __init__(self, message: str, line: int | None = None, col: int | None = None):
        super().__init__(message if line is None else f"{message} (line {line}, column {col})")
        self.line, self.col = line, col
