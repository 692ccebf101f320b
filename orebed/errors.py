"""Errors with a place in the source text."""

from __future__ import annotations


class EngineError(Exception):
    """An error of a catalog, a value or an execution."""


class Diagnostic(EngineError):
    """A message about a span of source text, with line and column counted from one."""

    def __init__(self, message: str, source: str = "", start: int = 0, end: int | None = None, notes: tuple[str, ...] = ()) -> None:
        raw = source.encode()[:start].decode("utf-8", "replace")
        self.message, self.span, self.notes = message, (start, start if end is None else end), notes
        self.line, self.column = raw.count("\n") + 1, len(raw) - (raw.rfind("\n") + 1) + 1
        super().__init__(f"{self.line}:{self.column}: {message}" + "".join(f"\n  note: {n}" for n in notes))


class Diagnostics(EngineError):
    """All problems of one compilation."""

    def __init__(self, items: list[Diagnostic]) -> None:
        self.items = items
        super().__init__("\n".join(map(str, items)))
