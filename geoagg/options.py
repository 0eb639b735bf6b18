"""Options of a clustered dataset."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

MAX_ZOOM = 16


@dataclass(frozen=True)
class ClusterOptions:
    """``radius`` in pixels of a world of ``extent`` pixels at zoom 0; groups of fewer than ``min_points`` stay points."""

    min_zoom: int = 0
    max_zoom: int = MAX_ZOOM
    min_points: int = 3
    radius: float = 40.0
    node_size: int = 64
    extent: int = 512

    def normalized(self) -> ClusterOptions:
        """Defaults for values out of range; min_zoom is held below max_zoom before max_zoom is capped."""
        low = max(self.min_zoom, 0)
        high = self.max_zoom if self.max_zoom > 0 else MAX_ZOOM
        low = min(low, high)
        return replace(
            self,
            min_zoom=low,
            max_zoom=min(high, MAX_ZOOM),
            min_points=self.min_points if self.min_points > 0 else 3,
            radius=self.radius if self.radius > 0 else 40.0,
            node_size=self.node_size if self.node_size > 0 else 64,
            extent=self.extent if self.extent > 0 else 512,
        )

    def effective_zoom(self, zoom: int) -> int:
        """Zooms outside 0 .. max_zoom are projected at zoom 0."""
        return zoom if 0 <= zoom <= self.max_zoom else 0

    def world(self, zoom: int) -> float:
        return float(self.extent * 2 ** self.effective_zoom(zoom))


#: What the service creates datasets with.
SERVICE_OPTIONS = ClusterOptions(min_points=2, radius=100.0)


@dataclass(frozen=True)
class Bounds:
    """A closed rectangle, in degrees or in pixels."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float

    @classmethod
    def from_texts(cls, north: str, south: str, east: str, west: str) -> Bounds:
        """Degrees given as texts, as a request has them; ``ValueError`` names the one that is no finite number."""
        values = {}
        for name, text in (("north", north), ("south", south), ("east", east), ("west", west)):
            try:
                values[name] = float(text)
            except (TypeError, ValueError):
                raise ValueError(f"{name}: {text!r} is no number") from None
            if not math.isfinite(values[name]):
                raise ValueError(f"{name}: {text!r} is not finite")
        return cls(values["west"], values["south"], values["east"], values["north"])


WORLD = Bounds(-180.0, -90.0, 180.0, 90.0)
