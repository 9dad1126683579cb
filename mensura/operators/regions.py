"""Areas of sets of polygons: what they cover together, without their holes.

The plane is cut into vertical strips at every vertex and crossing. Inside a
strip no edges cross, so each polygon is a set of intervals whose ends are
straight lines, and the covered area of a strip is its width times the length
covered at its middle. That is exact for any rings, crossing themselves or not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MEASURED = "case string, area_m2 double, sum_m2 double, flags array<string>"


def _edges(ring: np.ndarray) -> np.ndarray:
    after = np.roll(ring, -1, axis=0)
    both = np.concatenate([ring, after], axis=1)
    both = both[both[:, 0] != both[:, 2]]  # upright edges bound no interval
    turn = both[:, 0] > both[:, 2]
    both[turn] = both[turn][:, [2, 3, 0, 1]]
    return both


def _crossings(e: np.ndarray) -> np.ndarray:
    """Where two edges cross, as x."""
    if len(e) < 2:
        return np.zeros(0)
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    i, j = np.triu_indices(len(e), 1)
    apart = slope[i] != slope[j]
    i, j = i[apart], j[apart]
    x = (base[j] - base[i]) / (slope[i] - slope[j])
    inside = (x > np.maximum(e[i, 0], e[j, 0])) & (x < np.minimum(e[i, 2], e[j, 2]))
    return x[inside]


def _inside(e: np.ndarray, x: float) -> list[tuple[float, float]]:
    """Intervals of a ring on the line at x, by the even-odd rule."""
    here = e[(e[:, 0] < x) & (e[:, 2] > x)]
    y = np.sort(here[:, 1] + (here[:, 3] - here[:, 1]) * (x - here[:, 0]) / (here[:, 2] - here[:, 0]))
    return list(zip(y[::2].tolist(), y[1::2].tolist()))


def _union(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _minus(spans: list[tuple[float, float]], holes: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out = []
    for low, high in spans:
        for a, b in holes:
            if b <= low or a >= high:
                continue
            if a > low:
                out.append((low, a))
            low = max(low, b)
            if low >= high:
                break
        if low < high:
            out.append((low, high))
    return out


def covered(regions: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[float, list[float]]:
    """The area that regions (outer ring, holes) cover together, and each one's own."""
    parts = [(_edges(outer), [_edges(h) for h in holes]) for outer, holes in regions]
    everything = [e for outer, holes in parts for e in (outer, *holes) if len(e)]
    if not everything:
        return 0.0, [0.0] * len(regions)
    all_edges = np.concatenate(everything)
    xs = np.unique(np.concatenate([all_edges[:, 0], all_edges[:, 2], _crossings(all_edges)]))
    total, own = 0.0, [0.0] * len(regions)
    length = lambda spans: sum(b - a for a, b in spans)
    for left, right in zip(xs[:-1], xs[1:]):
        x, spans = (left + right) / 2, []
        for i, (outer, holes) in enumerate(parts):
            mine = _minus(_inside(outer, x), _union([s for h in holes for s in _inside(h, x)]))
            own[i] += length(mine) * (right - left)
            spans += mine
        total += length(_union(spans)) * (right - left)
    return total, own


def _ring(points) -> np.ndarray | None:
    """A ring as an array, empty for fewer than three points; None where a point isn't finite."""
    r = np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2) if points is not None else np.zeros((0, 2))
    if not np.isfinite(r).all():
        return None
    return r if len(r) >= 3 else np.zeros((0, 2))


def _crosses_itself(ring: np.ndarray) -> bool:
    return len(_crossings(_edges(ring))) > 0


def measured(regions: DataFrame) -> DataFrame:
    """Net area of each case of regions(case, region_idx, outer, holes, k) in square metres.

    Regions that overlap count once and are flagged, as are rings that cross
    themselves; regions with points that aren't finite are left out and flagged.
    A case without a scale fails.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        flags, good = [], []
        k = group.k.iloc[0]
        if k is None or not np.isfinite(k):
            raise ValueError(f"case {group.case.iloc[0]} has no scale")
        for r in group.sort_values("region_idx").itertuples():
            outer, holes = _ring(r.outer), [_ring(h) for h in (r.holes if r.holes is not None else [])]
            if outer is None:
                flags.append(f"region {r.region_idx} left out: a point is not finite")
                continue
            if len(outer) and _crosses_itself(outer):
                flags.append(f"region {r.region_idx} crosses itself")
            good.append((outer, [h for h in holes if h is not None and len(h)]))
        total, own = covered(good)
        if total < 0.999 * sum(own):
            flags.append("regions overlap")
        return pd.DataFrame({"case": [group.case.iloc[0]], "area_m2": [round(total * k * k, 1)], "sum_m2": [round(sum(own) * k * k, 1)], "flags": [flags]})

    return regions.groupBy("case").applyInPandas(run, MEASURED)
