"""Settings as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The locked preset of the main variant."""

    alpha: float = 2.0
    top_c: int = 7
    fixed_k: int = 300
    epsilon: float = 175000.0
    eval_k: int = 5
    gamma: float = 0.10
    dim: int = 64
    seed: int = 42

    @staticmethod
    def check_partition(clusters: int, capacity: int, docs: int) -> None:
        """A partition needs clusters * capacity = docs."""
        if clusters * capacity != docs:
            raise ValueError(f"{clusters} clusters of {capacity} don't make {docs} documents")


#: For the small tables: every query passes the gate at this point.
SMALL = Settings(fixed_k=50)
