"""Text lines of one region's pixels, by named rules.

A splitter maps (ink, min_height, min_width) to lines (x1, y1, x2, y2, confidence) from top to bottom; ``ink`` is a
boolean array, true where a pixel is dark. They run inside tasks on regions of bounded size; Spark deals out
the regions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from boxline.functions.sizing import DENSE_EDGES, SIMPLE_EDGES

Line = tuple[int, int, int, int, float]

# Rules of the splitters.
PROJECTION_SHARE = 0.3
LEAST_PART = (8, 3, 20)
MERGE_GAP = 5


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of stretches of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def smoothed(ink: np.ndarray, min_height: int) -> np.ndarray:
    """Ink pixels per row as a moving average, zeros beyond both ends."""
    kernel = max(3, min_height // 3)
    kernel += 1 - kernel % 2
    total = np.concatenate([np.zeros(kernel // 2 + 1, int), ink.sum(axis=1), np.zeros(kernel // 2, int)]).cumsum()
    return (total[kernel:] - total[:-kernel]) / kernel


def projection(ink: np.ndarray, min_height: int, min_width: int) -> list[Line]:
    """Rows with more than 0.3 of the mean smoothed ink, over the whole width."""
    level = smoothed(ink, min_height)
    # Rows may lie at exactly 0.3 of the mean, so it matters that the mean adds them from top to bottom.
    mean = level.cumsum()[-1] / len(level)
    found = _runs(level > mean * PROJECTION_SHARE)
    return [
        (0, a, ink.shape[1], b, min(1.0, float(level[a:b].mean()))) for a, b in found if b - a >= min_height
    ]


def parts(ink: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of 8-connected parts, from the stretches of ink of each row."""
    root: list[int] = []
    boxes: list[list[int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(ink):
        current = []
        for a, b in _runs(row):
            own = len(root)
            root.append(own)
            boxes.append([a, y, b, y + 1, b - a])
            for c, d, other in above:
                # Diagonal neighbours touch too.
                if c <= b and a <= d:
                    one, two = sorted((find(own), find(other)))
                    if one != two:
                        root[two] = one
                        p, q = boxes[one], boxes[two]
                        boxes[one] = [
                            min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]
                        ]
            current.append((a, b, own))
        above = current
    return [
        (x1, y1, x2 - x1, y2 - y1, area)
        for i, (x1, y1, x2, y2, area) in enumerate(boxes) if root[i] == i
    ]


def component(ink: np.ndarray, min_height: int, min_width: int) -> list[Line]:
    """Parts joined to lines: one joins the part before when their centers differ by half the larger height."""
    high, wide, least = LEAST_PART
    kept = sorted(
        (y + h // 2, x, y, w, h, area) for x, y, w, h, area in parts(ink)
        if h >= high and w >= wide and area >= least
    )
    groups: list[list[tuple]] = []
    for part in kept:
        before = groups[-1][-1] if groups else None
        if before is not None and part[0] - before[0] <= max(part[4], before[4]) * 0.5:
            groups[-1].append(part)
        else:
            groups.append([part])
    out = []
    for group in groups:
        x1, y1 = min(p[1] for p in group), min(p[2] for p in group)
        x2, y2 = max(p[1] + p[3] for p in group), max(p[2] + p[4] for p in group)
        if y2 - y1 >= min_height:
            share = sum(p[5] for p in group) / ((x2 - x1) * (y2 - y1))
            out.append((x1, y1, x2, y2, min(1.0, share * len(group) / 10)))
    return out


def _spread(flags: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Whether any of ``size`` neighbours along ``axis`` is true."""
    total = np.insert(flags.astype(np.int32).cumsum(axis), 0, 0, axis)
    at = np.arange(flags.shape[axis])
    low = np.maximum(at - (size - 1 - size // 2), 0)
    high = np.minimum(at + size // 2 + 1, len(at))
    return (total.take(high, axis) - total.take(low, axis)) > 0


def closed(ink: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Ink with gaps of up to about ``wide`` x ``high`` pixels filled."""
    grown = _spread(_spread(ink, wide, 1), high, 0)
    # Shrinking is growing of what is left blank, with the neighbours mirrored.
    blank = ~grown[::-1, ::-1]
    return ~_spread(_spread(blank, wide, 1), high, 0)[::-1, ::-1]


def contour(ink: np.ndarray, min_height: int, min_width: int) -> list[Line]:
    """Boxes of ink that hangs together once gaps are closed."""
    whole = closed(ink, max(3, min_height // 5), max(5, min_width // 4))
    return sorted(
        (
            (x, y, x + w, y + h, min(1.0, 2 * area / (w * h)))
            for x, y, w, h, area in parts(whole) if h >= min_height and w >= min_width
        ),
        key=lambda line: (line[1] + (line[3] - line[1]) // 2, line[0]),
    )


def merged(lines: list[Line], gap: int = MERGE_GAP) -> list[Line]:
    """Lines closer than ``gap`` to the one before joined; the joined line ends where its last member ends."""
    out: list[Line] = []
    for line in lines:
        if out and line[1] - out[-1][3] < gap:
            a = out[-1]
            out[-1] = (min(a[0], line[0]), a[1], max(a[2], line[2]), line[3], max(a[4], line[4]))
        else:
            out.append(line)
    return out


SPLITTERS: dict[str, Callable] = {"projection": projection, "component": component, "contour": contour}
AUTO = "auto"


def splitter(name: str, edge_density: float | None, splitters: dict[str, Callable]) -> Callable:
    """The splitter called ``name``; ``auto`` chooses by edge density and joins close lines."""
    if name != AUTO:
        if name not in splitters:
            raise ValueError(f"unknown line splitter {name!r}; there are {', '.join(sorted(splitters))}, {AUTO}")
        return splitters[name]
    if edge_density is None or np.isnan(edge_density) or edge_density >= DENSE_EDGES:
        chosen = splitters["contour"]
    else:
        chosen = splitters["projection" if edge_density < SIMPLE_EDGES else "component"]
    return lambda *arguments: merged(chosen(*arguments))
