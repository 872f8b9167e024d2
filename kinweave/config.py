"""Search settings and the algorithm name."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Algorithm(Enum):
    """Which distance a search uses; names are read leniently, anything unknown means hops."""

    BFS = "bfs"
    DIJKSTRA = "dijkstra"

    @classmethod
    def parse(cls, name: str | None) -> Algorithm:
        return cls.DIJKSTRA if (name or "").strip().lower() == "dijkstra" else cls.BFS


@dataclass(frozen=True)
class PathConfig:
    """min_match 0 keeps every edge; top_related cuts each node's list after that filter."""

    min_match: float = 0.0
    top_related: int = 80
    weighted: bool = False

    @property
    def algorithm(self) -> Algorithm:
        return Algorithm.DIJKSTRA if self.weighted else Algorithm.BFS
