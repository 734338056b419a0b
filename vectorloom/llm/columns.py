"""Names for an operator's own columns beside those that come in."""

from __future__ import annotations

from collections.abc import Iterable


def private(columns: Iterable[str]) -> str:
    """A beginning that none of these names has, in either case; an operator's own columns begin with it."""
    taken, out = [c.lower() for c in columns], "__"
    while any(c.startswith(out) for c in taken):
        out += "_"
    return out
