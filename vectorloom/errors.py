"""What operators raise on bad parameters (at once) and on bad data (from one aggregate over it)."""

from __future__ import annotations


class ClusterError(ValueError):
    """Base of all errors here."""


class EmptyInput(ClusterError):
    """There are no rows."""


class InvalidParameter(ClusterError):
    def __init__(self, name: str, message: str):
        super().__init__(f"{name}: {message}")
        self.name = name


class InvalidClusterCount(ClusterError):
    def __init__(self, requested: int, n_items: int):
        super().__init__(f"{requested} clusters of {n_items} items")
        self.requested, self.n_items = requested, n_items


class DimensionMismatch(ClusterError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"vectors of {found} values where {expected} were expected")
        self.expected, self.found = expected, found


class ConstraintViolation(ClusterError):
    """Constraints contradict each other or can't be met."""


class NonFinite(ClusterError):
    """A vector holds a null, NaN or infinity."""
