"""Work that is done for many trips at once, against plain code a trip."""

import numpy as np

from wayveil.operators import clean


def _plain(p):
    def cost(i, k):
        sums = [0.0, 0.0]
        for a, b in zip(p[i:k], p[i + 1 : k + 1]):
            if (a == p[i]).all() and (b == p[k]).all():
                continue
            longer = np.hypot(*(p[k] - p[i])) > np.hypot(*(b - a))
            (s, e), (q0, q1) = ((p[i], p[k]), (a, b)) if longer else ((a, b), (p[i], p[k]))
            base, other = e - s, q1 - q0
            norm, size, dot = base @ base, np.linalg.norm(other), base @ other
            d = [np.linalg.norm(q - s - ((q - s) @ base) / (norm or 1) * base) for q in (q0, q1)]
            sums[0] += np.spacing(1.0) if norm == 0 else (d[0] ** 2 + d[1] ** 2) / (sum(d) or 1)
            sums[1] += 0 if (base == other).all() else size if dot <= 0 else size * np.sqrt(max(1 - (dot / (np.sqrt(norm) * size or 1)) ** 2, 0))
        return sum(np.log2(v) if v > 0 else 0.0 for v in sums)

    keep, i = {0, len(p) - 1}, 0
    for k in range(1, len(p)):
        if k - 1 > i and cost(i, k) > 0:
            i = k - 1
            keep.add(i)
    return sorted(keep)


def test_stretches_of_many_trips_are_weighed_at_once(monkeypatch):
    draw = np.random.default_rng(5)
    trips = [draw.normal(0, 3, (int(n), 2)) for n in draw.integers(1, 12, 400)] + [draw.integers(0, 2, (8, 2)).astype(float) for _ in range(100)] + [np.column_stack([np.arange(60.0), np.sin(np.arange(60.0) / 9)])]
    calls, weigh = [], clean._bits
    monkeypatch.setattr(clean, "_bits", lambda p, i, length: calls.append(len(i)) or weigh(p, i, length))
    got = clean._characteristic([t[:, 0] for t in trips], [t[:, 1] for t in trips])
    assert [list(g) for g in got] == [_plain(t) for t in trips]
    assert sum(calls) > 2000 and len(calls) < 200  # not one by one
    assert [list(g) for g in clean._characteristic([[], [1.0]], [[], [2.0]])] == [[], [0]]
