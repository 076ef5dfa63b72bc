"""A cover tree over integer vectors, for inner products within windows of scores.

Vectors are augmented by one coordinate that brings all of them to the same norm. Levels are prefixes
of one farthest-first order of centres: on each level centres are farther apart than the level's
radius and every vector is nearer than that to one of them, and a level's radius is a fixed part of
the one above. Each node keeps the largest distance of any vector below it, its covering radius.

For a query ``q``, a node with centre ``c`` and covering radius ``r`` holds inner products of
``q.c - |q| r`` to ``q.c + |q| r`` only.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BASE = 1.3
LEAF_ROWS = 16
#: Up to here sums of whole numbers are exact in doubles.
EXACT = float(1 << 52)
LONGEST = (1 << 63) - 1


def augmented(points: np.ndarray, norm: float) -> np.ndarray:
    """``points`` with the coordinate that gives each of them the norm ``norm``."""
    rest = np.sqrt(np.maximum(norm * norm - (points * points).sum(1), 0))
    return np.concatenate([points, rest[:, None]], 1)


def farthest_first(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``most`` centres, each the point farthest from those before it, their distances from
    those (the first one's is infinite), and the nearest centre of each point."""
    squares = (points * points).sum(1)
    nearest = np.zeros(len(points), np.int32)
    away = np.full(len(points), np.inf)
    centres, gaps = [], []
    at, gap = 0, np.inf
    while len(centres) < most and gap > 0:
        distance = squares + squares[at] - 2 * (points @ points[at])
        distance[at] = 0
        closer = distance < away
        nearest[closer] = len(centres)
        away = np.where(closer, np.maximum(distance, 0), away)
        centres.append(at)
        gaps.append(gap)
        at = int(away.argmax())
        gap = float(np.sqrt(away[at]))
    return np.array(centres), np.array(gaps), nearest


def inner(points: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products; beyond a long they stay at its ends."""
    if norm * float(np.sqrt(q @ q)) < EXACT:
        return (points @ q).astype(np.int64)
    whole = [int(x) for x in q]
    sums = (sum(int(a) * b for a, b in zip(p, whole, strict=True)) for p in points)
    return np.array([min(max(s, -LONGEST - 1), LONGEST) for s in sums], np.int64)


@dataclass
class Tree:
    """Vectors in the order of the leaves, what is known of each, and the levels of nodes.

    Of level ``k``, ``centres[k]`` are rows of ``points``, ``radii[k]`` the covering radii and
    ``parents[k]`` the nodes above; ``ends`` are the leaves' ends in ``points``.
    """

    points: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    unknown: np.ndarray
    labels: np.ndarray
    names: np.ndarray
    centres: list[np.ndarray]
    radii: list[np.ndarray]
    parents: list[np.ndarray]
    ends: np.ndarray
    norm: float

    @staticmethod
    def of(points, rows, ids, unknown, labels, norm: float) -> Tree:
        """A tree over ``points``; ``unknown`` marks null ids, ``labels`` are strings."""
        lifted = augmented(points, norm)
        chosen, gaps, leaf = farthest_first(lifted, max(1, len(points) // LEAF_ROWS))
        sizes, reach = [1], gaps[1] if len(gaps) > 1 else 0.0
        while sizes[-1] < len(chosen):
            reach /= BASE
            # Gaps fall from centre to centre, so a level is a prefix of them.
            size = int(np.searchsorted(-gaps, -reach, side="left"))
            if size > sizes[-1]:
                sizes.append(size)
        parents = [np.zeros(1, np.int32)]
        for above, size in zip(sizes, sizes[1:], strict=False):
            own = lifted[chosen[:size]]
            upper = own[:above]
            apart = (upper * upper).sum(1)[None] - 2 * own @ upper.T
            up = apart.argmin(1).astype(np.int32)
            up[:above] = np.arange(above)
            parents.append(up)
        order = np.argsort(leaf, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lifted = lifted[order]
        radii, node = [], leaf[order]
        for size, up in zip(sizes[::-1], parents[::-1], strict=True):
            apart = np.sqrt(((lifted - lifted[place[chosen[node]]]) ** 2).sum(1))
            radius = np.zeros(size)
            np.maximum.at(radius, node, apart)
            radii.append(radius)
            node = up[node]
        names, codes = np.unique(labels.astype(str), return_inverse=True)
        return Tree(
            points[order],
            rows[order],
            ids[order],
            unknown[order],
            codes[order].astype(np.int32),
            names,
            [place[chosen[:size]] for size in sizes],
            radii[::-1],
            parents,
            np.cumsum(np.bincount(leaf, minlength=len(chosen))),
            norm,
        )

    def dumps(self) -> bytes:
        small = next(
            t
            for t in (np.int16, np.int32, np.float64)
            if t is np.float64 or np.abs(self.points).max(initial=0) <= np.iinfo(t).max
        )
        plain = {f: getattr(self, f) for f in "rows ids unknown labels names ends".split()}
        levels = {
            f"{f}{k}": level
            for f in ("centres", "radii", "parents")
            for k, level in enumerate(getattr(self, f))
        }
        out = io.BytesIO()
        np.savez(out, points=self.points.astype(small), norm=self.norm, **plain, **levels)
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as held:
            levels = {
                f: [held[f"{f}{k}"] for k in range(sum(n.startswith(f) for n in held.files))]
                for f in ("centres", "radii", "parents")
            }
            plain = {f: held[f] for f in "rows ids unknown labels names ends".split()}
            return Tree(
                points=held["points"].astype(np.float64), norm=float(held["norm"]), **plain, **levels
            )

    def bounds(self, queries: np.ndarray, lowest: np.ndarray, highest: np.ndarray):
        """Least and greatest inner product of every query with every leaf; nodes outside of a
        query's ``lowest`` to ``highest`` are left with all below them, which then get no range."""
        norms = np.sqrt((queries * queries).sum(1))[:, None]
        slack = 1e-9 * (norms * self.norm + 1)
        alive = np.ones((len(queries), 1), bool)
        for centres, radii, up in zip(self.centres, self.radii, self.parents, strict=True):
            alive = alive[:, up]
            used = np.flatnonzero(alive.any(0))
            low = np.full(alive.shape, np.inf)
            high = np.full(alive.shape, -np.inf)
            middle = queries @ self.points[centres[used]].T
            width = norms * radii[used] + slack
            low[:, used], high[:, used] = middle - width, middle + width
            alive &= (high >= lowest[:, None]) & (low <= highest[:, None])
        return np.where(alive, low, np.inf), np.where(alive, high, -np.inf)

    def best(
        self, q, row: int, label: str, same: bool, k: int, windows: np.ndarray, low, high
    ) -> list[np.ndarray]:
        """For each window (least score, greatest score) the places of its ``k`` best vectors with
        the query's label, or with another; equal scores by id. Leaves are read best bound first,
        until none that is left could add to any window. The query's own ``row`` is left out."""
        code = np.searchsorted(self.names, label)
        code = code if code < len(self.names) and self.names[code] == label else -1
        need, most = windows[:, 0].copy(), windows[:, 1]
        found = [np.zeros(0, np.int64) for _ in windows]
        scores = [np.zeros(0, np.int64) for _ in windows]
        order = np.flatnonzero(high > -np.inf)
        order = order[np.argsort(-high[order], kind="stable")]
        at, width = 0, 4
        while at < len(order) and high[order[at]] >= need.min():
            wave = order[at : at + width]
            at, width = at + width, width * 2
            useful = (high[wave, None] >= need) & (low[wave, None] <= most)
            wave = wave[useful.any(1)]
            if not len(wave):
                continue
            last = self.ends[wave]
            size = last - np.where(wave > 0, self.ends[wave - 1], 0)
            places = np.repeat(last - np.cumsum(size), size) + np.arange(size.sum())
            places = places[(self.labels[places] == code) == same]
            places = places[self.rows[places] != row]
            score = inner(self.points[places], q, self.norm)
            for w in np.flatnonzero(useful.any(0)):
                inside = np.flatnonzero((score >= need[w]) & (score <= most[w]))
                if not len(inside):
                    continue
                place = np.concatenate([found[w], places[inside]])
                value = np.concatenate([scores[w], score[inside]])
                first = np.lexsort((self.ids[place], self.unknown[place], -value))[:k]
                found[w], scores[w] = place[first], value[first]
                if len(first) == k:
                    need[w] = value[first[-1]]
        return list(zip(found, scores, strict=True))


def ranges(centres: np.ndarray, radii: np.ndarray, queries: np.ndarray, norm: float):
    """Least and greatest inner product of every query with every cell (centre and radius)."""
    norms = np.sqrt((queries * queries).sum(1))[:, None]
    middle = queries @ centres.T
    width = norms * radii + 1e-9 * (norms * norm + 1)
    return middle - width, middle + width


def each(values: np.ndarray, size: int) -> Iterator[slice]:
    for at in range(0, len(values), size):
        yield slice(at, at + size)
