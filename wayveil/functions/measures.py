"""Pair measures over arrays, as pandas functions: a pair a row, many of them computed at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def _points(a) -> np.ndarray:
    return np.array([[p["x"], p["y"]] for p in a], float).reshape(-1, 2)


def _metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great circle distances of all points of a to all of b, (lon, lat) in degrees."""
    p, q = np.radians(a)[:, None], np.radians(b)[None]
    h = np.sin((q[..., 1] - p[..., 1]) / 2) ** 2 + np.cos(p[..., 1]) * np.cos(q[..., 1]) * np.sin((q[..., 0] - p[..., 0]) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _plane(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])


def dtw_many(ax, ay, bx, by, limit: np.ndarray | None = None) -> np.ndarray:
    """DTW of many pairs of point sequences, anti-diagonal by anti-diagonal; infinite where it is above the pair's limit.

    Pairs of like sizes are taken together, some STEP numbers at once. A path steps over one anti-diagonal at most, so a
    pair leaves when all of two neighbouring ones are above its limit.
    """
    ax, ay, bx, by = (list(side) for side in (ax, ay, bx, by))  # a look into a Series takes microseconds
    m, n = (np.array([len(x) for x in side], np.int64) for side in (ax, bx))
    out = np.full(len(m), np.inf)
    limit = np.full(len(m), np.inf) if limit is None else np.asarray(limit, float)
    order = np.lexsort((np.maximum(m, n), np.minimum(m, n)))
    order = order[(m[order] > 0) & (n[order] > 0)]
    while len(order):
        width = np.maximum(m[order], n[order])
        upto = max(1, int(np.searchsorted(np.arange(1, len(order) + 1) * np.maximum.accumulate(width), STEP)))
        some, order = order[:upto], order[upto:]
        out[some] = _wavefront([ax[k] for k in some], [ay[k] for k in some], [bx[k] for k in some], [by[k] for k in some], m[some], n[some], limit[some])
    return out


#: Numbers of a side that a step of the wavefront takes.
STEP = 1 << 14


def _wavefront(ax, ay, bx, by, m: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    def padded(rows, sizes):
        out = np.zeros((len(rows), int(sizes.max())))
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(rows)
        return out

    most_m, most_n = int(m.max()), int(n.max())
    ax, ay, bx, by = padded(ax, m), padded(ay, m), padded(bx, n), padded(by, n)
    out, who, most = np.full(len(m), np.inf), np.arange(len(m)), limit
    before = last = np.full((len(m), most_m + 1), np.inf)  # place i + 1 has point i of a
    for k in range(most_m + most_n - 1):
        low, high = max(0, k - most_n + 1), min(most_m - 1, k)
        there = slice(k - high, k - low + 1)
        dx, dy = ax[:, low : high + 1] - bx[:, there][:, ::-1], ay[:, low : high + 1] - by[:, there][:, ::-1]
        cost = np.sqrt(dx * dx + dy * dy)  # as the SQL takes it; hypot can differ in the last bit
        best = np.minimum(np.minimum(last[:, low + 1 : high + 2], last[:, low : high + 1]), before[:, low : high + 1]) if k else 0.0
        now = np.full_like(last, np.inf)
        now[:, low + 1 : high + 2] = cost + best
        ended = m + n - 2 == k
        out[who[ended]] = now[ended, m[ended]]
        stay = ~ended & (np.minimum(now.min(axis=1), last.min(axis=1)) <= limit)
        before, last = last, now
        if not stay.any():
            break
        if 2 * stay.sum() <= len(stay):
            ax, ay, bx, by, m, n, limit, who, before, last = (x[stay] for x in (ax, ay, bx, by, m, n, limit, who, before, last))
    out[out > most] = np.inf
    return out


def edit_table(match: np.ndarray, step: float) -> float:
    """Least cost path over match costs; each skip costs `step`."""
    n = match.shape[1]
    row = np.arange(n + 1) * step
    for cost in match:
        low = np.minimum(row[:-1] + cost, row[1:] + step)
        # new[j] = min over k <= j of low[k] + (j - k) * step: a running minimum after taking the slope away
        slope = np.arange(n + 1) * step
        row = np.minimum.accumulate(np.concatenate([[row[0] + step], low]) - slope) + slope
    return float(row[-1])


def common(a, b, lengths: dict | None = None) -> float:
    """Length-weighted longest common subsequence.

    An id has one length, so a match never loses against a skip, and a row is the running maximum of what the row before
    has there and what a match adds. Without lengths, rows are sets of steps, the bits of one whole number.
    """
    if not len(a) or not len(b):
        return 0.0
    if lengths is None:
        places: dict = {}
        for k, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << k
        whole = (1 << len(a)) - 1
        row = whole
        for y in b:
            met = row & places.get(y, 0)
            row = ((row + met) | (row - met)) & whole
        return float(len(a) - row.bit_count())
    ids: dict = {}
    codes = [np.array([ids.setdefault(x, len(ids)) for x in side]) for side in (a, b)]
    weights = np.array([lengths.get(x, 1.0) for x in ids])
    row = np.zeros(len(b) + 1)
    for x in codes[0]:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(codes[1] == x, row[:-1] + weights[x], 0.0)))
    return float(row[-1])


def _pairs(f):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)], dtype=float)

    return over


def _edr(far: np.ndarray, p: dict) -> float:
    return float(max(far.shape)) if not far.size else edit_table((far > p.get("threshold", 1000.0)).astype(float), 1.0)


def _erp(far: np.ndarray, p: dict) -> float:
    gap = p.get("gap", 1.0)
    return max(far.shape) * gap if not far.size else edit_table(far / 1000.0, gap)


def _tp(far: np.ndarray, p: dict) -> float:
    if not far.size:
        return 0.0
    d = np.exp(-far / 1000.0)
    space = d.max(axis=1).mean() + d.max(axis=0).mean()
    late = lambda m, n: np.exp(-np.maximum(np.arange(m) - (n - 1), 0)).mean()
    return -(0.99 * space + 0.01 * (late(*far.shape) + late(*far.shape[::-1])))


def matrix_measure(name: str, **p):
    """A column function of the distances (array, row by row) between the points of two trips and the trips' sizes."""
    score = {"edr": _edr, "erp": _erp, "tp": _tp}[name]

    def over(d: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([score(np.asarray(x, float).reshape(a, b), p) for x, a, b in zip(d, m, n)], dtype=float)

    return F.pandas_udf(over, "double")


def measure(name: str, **p):
    """A column function of two arrays. edr, erp, dtw, tp: of points (x, y); lcrs: of segment ids. planar=True: no degrees."""
    far = _plane if p.get("planar") else _metres

    def edr(a, b):
        return _edr(far(_points(a), _points(b)), p)

    def erp(a, b):
        return _erp(far(_points(a), _points(b)), p)

    def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
        left, right = ([_points(x) for x in side] for side in (a, b))
        return pd.Series(dtw_many([x[:, 0] for x in left], [x[:, 1] for x in left], [x[:, 0] for x in right], [x[:, 1] for x in right]), dtype=float)

    def tp(a, b):
        return _tp(far(_points(a), _points(b)), p)

    def lcrs(a, b):
        both = common(list(a), list(b))
        whole = len(a) + len(b) - both
        return -both / whole if whole > 0 else 0.0

    return F.pandas_udf(dtw if name == "dtw" else _pairs({"edr": edr, "erp": erp, "tp": tp, "lcrs": lcrs}[name]), "double")


def lors():
    """Negative weighted overlap of two arrays of (id, length)."""

    def f(a, b):
        lengths = {x["id"]: x["length"] for x in [*a, *b]}
        return -common([x["id"] for x in a], [x["id"] for x in b], lengths)

    return F.pandas_udf(_pairs(f), "double")
