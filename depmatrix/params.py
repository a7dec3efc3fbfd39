"""Parameters of an analysis."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Constraints:
    """Limits on clusters. bus_threshold None: adaptive. max_external_ratio only raises a flag."""

    min_cluster_size: int = 2
    max_cluster_size: int = 20
    min_clusters: int = 2
    max_clusters: int = 10
    bus_threshold: float | None = None
    max_external_ratio: float = 0.30
    seed: int | None = None

    @classmethod
    def of(cls, given: dict) -> Constraints:
        """From strings or numbers; empty and missing values take the defaults, unknown names are ignored."""
        out = {}
        for f in fields(cls):
            value = given.get(f.name)
            if value is None or isinstance(value, str) and not value.strip():
                continue
            out[f.name] = float(value) if "threshold" in f.name or "ratio" in f.name else int(float(value))
        return cls(**out)

    def k_range(self, n: int) -> tuple[int, int]:
        low = max(2, min(self.min_clusters, n - 1))
        return low, max(low, min(self.max_clusters, n - 1))
