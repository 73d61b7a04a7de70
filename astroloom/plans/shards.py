"""Which shards of a HEALPix-partitioned table a cone can touch."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from ..functions import healpix, sphere


@dataclass(frozen=True)
class Shard:
    order: int
    pixel: int
    path: str


@lru_cache(maxsize=65536)
def _cap(order: int, pixel: int) -> tuple[float, float, float]:
    return healpix.cap(order, pixel)


def kept(shards: list[Shard], ra0: float, dec0: float, radius: float) -> list[Shard]:
    """Never fewer than the cone needs: a shard goes only if its bounding cap
    and the cone are apart."""
    out = []
    for s in shards:
        ra, dec, reach = _cap(s.order, s.pixel)
        if sphere.separation(ra, dec, ra0, dec0) <= radius + reach + 1e-9:
            out.append(s)
    return out
