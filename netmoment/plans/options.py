"""Settings that a caller may change for a while."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """mc_above: nodes above which motifs are estimated; mc_draws: draws then; exact_nodes and mc_nodes: nodes above which sums go by classes of mu, of which exact_nodes is the bound."""

    mc_above: int = 1000
    mc_draws: int = 50
    exact_nodes: int = 100_000
    mc_nodes: int = 4_000_000
    mc_repeat: int = 1

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if not isinstance(v, int) or isinstance(v, bool) or v <= 0:
                raise ValueError(f"{f.name} must be a positive integer, got {v!r}")


_current = Options()


def get(name: str | None = None) -> Options | int:
    return _current if name is None else getattr(_current, name)


def set_(**changes: int) -> Options:
    global _current
    _current = replace(_current, **changes)
    return _current


def reset() -> Options:
    global _current
    _current = Options()
    return _current


def to_dict() -> dict[str, int]:
    return asdict(_current)


@contextmanager
def using(**changes: int) -> Iterator[Options]:
    """Changes that end with the block; what was set before comes back."""
    global _current
    before = _current
    try:
        yield set_(**changes)
    finally:
        _current = before
