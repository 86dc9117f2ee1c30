"""Typed failures.  Problems inside a sheet are error values instead; see ``functions.values``."""


class FormulaError(Exception):
    """``code``: parse-error, unsupported, depth-exceeded, too-many-args, budget-exceeded or volatile-unconfigured."""

    def __init__(self, code: str, message: str, position: int | None = None) -> None:
        super().__init__(message)
        self.code, self.position = code, position


class WorkbookError(Exception):
    """``code``: not-a-zip, not-xlsx, missing-part, corrupt-zip, unsupported, no-such-sheet, part-too-large or invalid-input."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code

    def __reduce__(self):
        return (WorkbookError, (self.code, str(self)))
