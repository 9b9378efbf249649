"""Shortest paths over the states of an adaptive grid, from many states of one top cell at once.

Inside a top cell the states are a lattice, so the distance between two of them is a sum of whole steps; a path enters a cell
at one of its sides. Distances are worked out for the sides of all cells first, until none gets shorter, and then for the
states inside. They are whole numbers of 1e-9, each times the scale plus the number of steps, so that of paths of one length
the one with the fewest states wins.
"""

from __future__ import annotations

import numpy as np

_FAR = 1 << 62


def _spread(a: np.ndarray, w: int) -> np.ndarray:
    """Along a side: the least of every place's number plus w a step from there."""
    ramp = np.arange(a.shape[1], dtype=np.int64) * w
    a = np.minimum.accumulate(a - ramp, axis=1) + ramp
    return (np.minimum.accumulate(a[:, ::-1] - ramp, axis=1) + ramp)[:, ::-1]


class Lattice:
    """States 0, 1, ... of the cells that follow each other, in the order of (si, sj) inside a cell; links between two cells
    join all states of a side of one with all of a side of the other."""

    def __init__(self, first, m, across, down, links, scale: int):
        self.first, self.m, self.across, self.down, self.links, self.scale = first, m, across, down, links, scale
        self.states = int(first[-1] + m[-1] ** 2)

    @classmethod
    def of(cls, cell: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> Lattice | None:
        """From each state's cell and the edges (a, b, far), sorted by a and b; None where they are not such states."""
        if not len(cell) or (np.diff(cell) < 0).any() or ((np.diff(a) == 0) & (np.diff(b) == 0)).any() or not len(a):
            return None
        _, first, size = np.unique(cell, return_index=True, return_counts=True)
        m = np.rint(np.sqrt(size)).astype(np.int64)
        if (m * m != size).any() or len(cell) < 16 * len(m):  # few states a cell are searched one by one
            return None
        scale = 1 << int(len(cell)).bit_length()
        whole = np.rint(far * 1e9)
        if (np.abs(whole / 1e9 - far) > 1e-10).any() or float(whole.max()) * scale >= 2.0**60:
            return None
        w = whole.astype(np.int64) * scale + 1
        own = np.repeat(np.arange(len(m)), size)
        ca, cb, at, to = own[a], own[b], a - first[own[a]], b - first[own[b]]
        across, down, links = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), []
        for key in np.unique(ca * len(m) + cb):
            c, d = divmod(int(key), len(m))
            edges = np.flatnonzero((ca == c) & (cb == d))
            p, q, x = at[edges], to[edges], w[edges]
            if c == d:
                tall, wide = np.abs(p - q) == m[c], (np.abs(p - q) == 1) & (p // m[c] == q // m[c])
                if m[c] == 1 or not (tall | wide).all() or len(p) != 4 * m[c] * (m[c] - 1) or (tall & wide).any() or len(np.unique(x[tall])) != 1 or len(np.unique(x[wide])) != 1:
                    return None
                across[c], down[c] = x[tall][0], x[wide][0]
                continue
            ps, qs = np.unique(p), np.unique(q)
            sides = [next((k for k in range(4) if np.array_equal(cls._side(m[e], k), have)), None) for e, have in ((c, ps), (d, qs))]
            if None in sides or len(p) != len(ps) * len(qs):
                return None
            links.append((c, d, sides[0], sides[1], np.ascontiguousarray(x.reshape(len(ps), len(qs)).T)))
        # No shortest path is longer than one through every cell once.
        longest = float(((m - 1) * (across.astype(float) + down)).sum()) + len(m) * float(w.max())
        if ((across == 0) & (m > 1)).any() or longest >= 2.0**60:
            return None
        return cls(first, m, across, down, links, scale)

    @staticmethod
    def _side(m: int, k: int) -> np.ndarray:
        """The places of a side inside its cell: si = 0, si = m - 1, sj = 0, sj = m - 1."""
        along = np.arange(m)
        return (along, (m - 1) * m + along, along * m, along * m + m - 1)[k]

    def _close(self, s: list[np.ndarray], c: int) -> list[np.ndarray]:
        """The four sides of a cell with what they reach through the cell."""
        m, h, v = int(self.m[c]), int(self.across[c]), int(self.down[c])
        s = [np.minimum(s[0], s[1] + (m - 1) * h), np.minimum(s[1], s[0] + (m - 1) * h), np.minimum(s[2], s[3] + (m - 1) * v), np.minimum(s[3], s[2] + (m - 1) * v)]
        s = [_spread(x, v if k < 2 else h) for k, x in enumerate(s)]
        for k, i, l, j in ((0, 0, 2, 0), (0, -1, 3, 0), (1, 0, 2, -1), (1, -1, 3, -1)):  # the corners are in two sides
            s[k][:, i] = s[l][:, j] = np.minimum(s[k][:, i], s[l][:, j])
        return [_spread(x, v if k < 2 else h) for k, x in enumerate(s)]

    def search(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, coarse) from sources of one cell, a row a source and a column a state; 0 steps where no path is."""
        n, own = len(sources), int(np.searchsorted(self.first, sources[0], "right")) - 1
        i0, j0 = np.divmod((sources - self.first[own])[:, None], self.m[own])
        sides = [[np.full((n, k), _FAR) for _ in range(4)] for k in self.m]
        along, h, v = np.arange(self.m[own]), self.across[own], self.down[own]
        last = self.m[own] - 1
        sides[own] = [i0 * h + np.abs(along - j0) * v, (last - i0) * h + np.abs(along - j0) * v, j0 * v + np.abs(along - i0) * h, (last - j0) * v + np.abs(along - i0) * h]
        out = [[k for k in self.links if k[0] == c] for c in range(len(self.m))]
        todo = {own: 0}
        while todo:
            c = min(todo, key=todo.get)
            del todo[c]
            sides[c] = self._close(sides[c], c)
            for _, d, s, t, x in out[c]:
                new = (sides[c][s][:, None, :] + x).min(axis=2)
                nearer = new < sides[d][t]
                if nearer.any():
                    todo[d] = min(todo.get(d, _FAR), int(new[nearer].min()))
                    sides[d][t] = np.minimum(sides[d][t], new)
        dist = np.empty((n, self.states), np.int64)
        before = np.broadcast_to(np.arange(self.states, dtype=np.int32), (n, self.states)).copy()
        moved = np.zeros((n, self.states), np.int32)
        for c, m in enumerate(self.m):
            own_states = slice(int(self.first[c]), int(self.first[c] + m * m))
            h, v, up = self.across[c], self.down[c], np.arange(m)
            s = sides[c]
            f = np.minimum(s[0][:, None, :] + (up * h)[:, None], s[1][:, None, :] + ((m - 1 - up) * h)[:, None])
            f = np.minimum(f, np.minimum(s[2][:, :, None] + up * v, s[3][:, :, None] + (m - 1 - up) * v))
            if c == own:
                f = np.minimum(f, (np.abs(up - i0) * h)[:, :, None] + (np.abs(up - j0) * v)[:, None, :])
            dist[:, own_states] = f.reshape(n, -1)
            # The state before: of all that lie on a shortest path the smallest, so smaller ones are written later.
            p, k = before[:, own_states].reshape(n, m, m), moved[:, own_states].reshape(n, m, m)
            place = np.arange(own_states.start, own_states.stop, dtype=np.int32).reshape(m, m)
            into = sorted((x for x in self.links if x[1] == c), key=lambda x: -x[0])

            def enter(links):
                for e, _, a, t, x in links:
                    side = (np.s_[:, 0, :], np.s_[:, -1, :], np.s_[:, :, 0], np.s_[:, :, -1])[t]
                    tight = sides[e][a][:, None, :] + x == f[side][:, :, None]
                    there = tight.any(axis=2) & (f[side] < _FAR)
                    p[side] = np.where(there, (self.first[e] + self._side(self.m[e], a)[tight.argmax(axis=2)]).astype(np.int32), p[side])
                    k[side] = np.where(there, 1, k[side])

            enter([x for x in into if x[0] > c])
            if m > 1:
                for to, at, w in ((np.s_[:, :-1, :], np.s_[:, 1:, :], h), (np.s_[:, :, :-1], np.s_[:, :, 1:], v), (np.s_[:, :, 1:], np.s_[:, :, :-1], v), (np.s_[:, 1:, :], np.s_[:, :-1, :], h)):
                    tight = f[to] == f[at] + w
                    p[to] = np.where(tight, np.broadcast_to(place, f.shape)[at], p[to])
                    k[to] = np.where(tight, 0, k[to])
            enter([x for x in into if x[0] < c])
            before[:, own_states], moved[:, own_states] = p.reshape(n, -1), k.reshape(n, -1)
        reached = dist < _FAR
        steps = np.where(reached, dist % self.scale + 1, 0).astype(np.int32)
        before, moved = (before + (np.arange(n, dtype=np.int32) * self.states)[:, None]).ravel(), moved.ravel()
        for _ in range(int(steps.max()).bit_length()):  # each round follows twice as many states back
            moved = moved + moved[before]
            before = before[before]
        return steps, np.where(reached, moved.reshape(n, -1) + 1, 0).astype(np.int32)
