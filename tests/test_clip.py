"""Polygons cut to polygons, against cells counted one by one and areas by triangles."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from hydrospark.operators import clip

POINTS = "fid long, part int, ring int, pos int, x double, y double"


def rows_of(fid, parts):
    return [(fid, p, r, k, float(x), float(y)) for p, rings in enumerate(parts) for r, ring in enumerate(rings) for k, (x, y) in enumerate([*ring, ring[0]])]


def frame(spark, polygons):
    return spark.createDataFrame([row for fid, parts in polygons.items() for row in rows_of(fid, parts)], POINTS)


def cut(spark, polygons, extent):
    """Rings by polygon and outer ring: ``{fid: [[outer, *holes], ...]}``."""
    found = defaultdict(lambda: defaultdict(list))
    for r in clip.clip_polygons(frame(spark, polygons), frame(spark, {0: extent}).drop("fid")).collect():
        found[r.fid][r.outer, r.ring].append((r.pos, r.x, r.y))
    out = {}
    for fid, rings in found.items():
        by = defaultdict(list)
        for (outer, ring), points in sorted(rings.items(), key=lambda x: x[0][0] != x[0][1]):
            points = sorted(points)
            assert [p[0] for p in points] == list(range(len(points))) and points[0][1:] == points[-1][1:]
            by[outer].append([p[1:] for p in points])
        out[fid] = list(by.values())
    return out


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def holds(parts, x, y):
    n = 0
    for rings in parts:
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
                n += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return n % 2 == 1


def cells(parts, n=20):
    return {(x, y) for x in range(-2, n) for y in range(-2, n) if holds(parts, x + 0.5, y + 0.5)}


def components(some):
    left, n = set(some), 0
    while left:
        n, queue = n + 1, [left.pop()]
        while queue:
            x, y = queue.pop()
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left:
                    left.remove(c)
                    queue.append(c)
    return n


BOX = [(2, 2), (14, 2), (14, 12), (2, 12)]
U = [(0, 0), (16, 0), (16, 14), (11, 14), (11, 5), (5, 5), (5, 14), (0, 14)]
RECTILINEAR = {
    "u_cut_above_its_base": ([[[(0, 7), (16, 7), (16, 18), (0, 18)]]], [[U]]),
    "l_in_u": ([[[(3, 3), (13, 3), (13, 9), (8, 9), (8, 13), (3, 13)]]], [[U]]),
    "same": ([[BOX]], [[BOX]]),
    "beside": ([[BOX]], [[[(14, 2), (18, 2), (18, 12), (14, 12)]]]),
    "corner": ([[BOX]], [[[(14, 12), (18, 12), (18, 16), (14, 16)]]]),
    "inside": ([[[(4, 4), (6, 4), (6, 6), (4, 6)]]], [[BOX]]),
    "around": ([[[(-1, -1), (19, -1), (19, 19), (-1, 19)]]], [[BOX]]),
    "hole_of_the_lake": ([[BOX, [(4, 4), (4, 8), (8, 8), (8, 4)]]], [[[(6, 0), (18, 0), (18, 10), (6, 10)]]]),
    "hole_of_the_extent": ([[[(3, 3), (13, 3), (13, 11), (3, 11)]]], [[BOX, [(5, 5), (9, 5), (9, 9), (5, 9)]]]),
    "island": ([[BOX, [(4, 4), (10, 4), (10, 10), (4, 10)]], [[(6, 6), (8, 6), (8, 8), (6, 8)]]], [[[(0, 0), (18, 0), (18, 18), (0, 18)]]]),
    "shared_border": ([[BOX]], [[[(2, 2), (8, 2), (8, 7), (2, 7)]], [[(9, 7), (14, 7), (14, 12), (9, 12)]]]),
    "touching_parts": ([[[(0, 0), (8, 0), (8, 8), (0, 8)]]], [[[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(4, 4), (8, 4), (8, 8), (4, 8)]]]),
    "away": ([[BOX]], [[[(15, 15), (17, 15), (17, 17), (15, 17)]]]),
}


def test_rectilinear_polygons_cell_by_cell(spark):
    """Every case at a place of its own, in one extent of many parts; extents run either way round."""
    moved = lambda parts, k, turn=1: [[[(x + 40 * k, y) for x, y in ring][::turn] for ring in part] for part in parts]
    extent = [part for k, (_, e) in enumerate(RECTILINEAR.values()) for part in moved(e, k, -1 if k % 2 else 1)]
    got = cut(spark, {k: moved(lake, k) for k, (lake, _) in enumerate(RECTILINEAR.values())}, extent)
    for k, (name, (lake, own)) in enumerate(RECTILINEAR.items()):
        want = cells(lake) & cells(own)
        parts = moved(got.get(k, []), -k)
        assert cells([[r[:-1] for r in p] for p in parts]) == want, name
        assert sum(area(r) for p in parts for r in p) == len(want), name
        assert len(parts) == components(want), name
        assert all((area(r) > 0) == (i == 0) for p in parts for i, r in enumerate(p)), name


def star(r, cx, cy, n, size):
    return [(cx + (s := size * r.uniform(0.3, 1)) * math.cos(2 * math.pi * k / n), cy + s * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_stars_in_a_star(spark, seed):
    """Spiky lakes in a spiky extent with a hole: areas by scan lines, parts within both."""
    r = random.Random(seed)
    lakes = {k: [[star(r, r.uniform(0, 40), r.uniform(0, 40), r.randrange(3, 40), r.uniform(1, 15))]] for k in range(25)}
    extent = [[star(r, 20, 20, 31, 24), star(r, 20, 20, 7, 5)[::-1]]]
    got = cut(spark, lakes, extent)

    def scanned(parts):
        """The area that both sides have in common along fine scan lines."""
        total, step = 0.0, 0.01
        for k in range(-500, 5000):
            y = k * step + 0.00371
            xs = [sorted(ax + (y - ay) * (bx - ax) / (by - ay) for rings in side for ring in rings for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True) if (ay > y) != (by > y)) for side in parts]
            spans = [list(zip(x[::2], x[1::2], strict=True)) for x in xs]
            total += step * sum(max(0.0, min(b, d) - max(a, c)) for a, b in spans[0] for c, d in spans[1])
        return total

    for k, lake in lakes.items():
        mine = sum(area(ring) for p in got.get(k, []) for ring in p)
        want = scanned([lake, extent])
        assert abs(mine - want) < 0.02 + 0.002 * want, k
    assert any(len(p) > 1 for p in got.values())
    assert not clip.clip_polygons(frame(spark, {}), frame(spark, {0: extent}).drop("fid")).take(1)
