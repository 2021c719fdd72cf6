"""How the catalogues write patterns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class exact:  # noqa: N801
    """A pattern for which case matters."""

    pattern: str


def flags_and_pattern(entry: str | exact) -> tuple[str, str]:
    return ("", entry.pattern) if isinstance(entry, exact) else ("i", entry)
