"""Predicates on time-frequency boxes; a box is a struct or a set of columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(start: Column, duration: Column, center: Column, width: Column, fft_size: int, sample_rate: float) -> dict[str, Column]:
    """Corners in FFT coordinates: x in frames, y in bins of half the sample rate, from center +- bandwidth.

    The full bandwidth on either side makes boxes about twice as high as the band; kept as the meaning of these boxes.
    """
    y = lambda f: F.bround(f / (sample_rate / 2) * fft_size)
    return {"x0": F.bround(start / fft_size), "y0": y(center - width), "x1": F.bround((start + duration) / fft_size), "y1": y(center + width)}


def within(x: Column, low: Column, high: Column) -> Column:
    return (x >= low) & (x <= high)


def corner_inside(x: Column, y: Column, b: dict) -> Column:
    return within(x, b["x0"], b["x1"]) & within(y, b["y0"], b["y1"])


def box_inside(a: dict, b: dict) -> Column:
    """All corners of a lie in b."""
    return corner_inside(a["x0"], a["y0"], b) & corner_inside(a["x1"], a["y1"], b)


def turns_left(ax, ay, bx, by, cx, cy) -> Column:
    """a, b, c run counter-clockwise (strictly)."""
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_cross(a, b, c, d) -> Column:
    """Segments ab and cd cross; a segment that only touches along its line does not count."""
    return (turns_left(*a, *c, *d) != turns_left(*b, *c, *d)) & (turns_left(*a, *b, *c) != turns_left(*a, *b, *d))


# The direction in which each side runs; it decides the cases in which three corners are in line.
SIDES = ((("x0", "y0"), ("x1", "y0")), (("x0", "y0"), ("x0", "y1")), (("x0", "y1"), ("x1", "y1")), (("x1", "y1"), ("x1", "y0")))


def _sides(b: dict):
    return [tuple((b[x], b[y]) for x, y in side) for side in SIDES]


def closed_overlap(a: dict, b: dict) -> Column:
    """The boxes share a point: implied by every other overlap predicate here."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def side_overlap(a: dict, b: dict) -> Column:
    """Some pair of sides crosses, or one box lies in the other.

    Misses boxes that overlap only along a common line; closed_overlap(strict) finds those.
    """
    out = box_inside(a, b) | box_inside(b, a)
    for s in _sides(a):
        for t in _sides(b):
            out = out | segments_cross(*s, *t)
    return out


def side_overlap_sql(a: str, b: str) -> str:
    """side_overlap for aliases a and b in SQL."""
    left = lambda p, q, r: f"(({r[1]}-{p[1]})*({q[0]}-{p[0]}) > ({q[1]}-{p[1]})*({r[0]}-{p[0]}))"
    sides = lambda t: [tuple((f"{t}.{x}", f"{t}.{y}") for x, y in side) for side in SIDES]
    cross = [f"(({left(p, r, s)} <> {left(q, r, s)}) AND ({left(p, q, r)} <> {left(p, q, s)}))" for p, q in sides(a) for r, s in sides(b)]
    inside = lambda u, v: f"({u}.x0 BETWEEN {v}.x0 AND {v}.x1 AND {u}.y0 BETWEEN {v}.y0 AND {v}.y1 AND {u}.x1 BETWEEN {v}.x0 AND {v}.x1 AND {u}.y1 BETWEEN {v}.y0 AND {v}.y1)"
    return "(" + " OR ".join([inside(a, b), inside(b, a), *cross]) + ")"


def cut_relation(start: Column, stop: Column, cut_start: Column, cut_stop: Column) -> Column:
    """How a removed stretch meets a signal: outside, inside (all gone), left, right or split."""
    return (
        F.when((cut_stop <= start) | (cut_start >= stop), "outside")
        .when((cut_start <= start) & (cut_stop >= stop), "inside")
        .when(cut_start <= start, "left")
        .when(cut_stop >= stop, "right")
        .otherwise("split")
    )
