"""Payoffs of packed structures, an Arrow batch at a time: legs as padded (structure, leg) arrays, prices as (structure, price) arrays.

Nulls are NaN; a comparison with NaN is false, as one with null is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barlattice.functions.options_math import _np_cdf

CELLS = 1 << 15  # (structure, price) cells worked on at once: arrays stay in the cache


def numbers(a) -> np.ndarray:
    return pc.fill_null(pc.cast(a, pa.float64()), np.nan).to_numpy(zero_copy_only=False)


class Legs:
    """``legs`` and ``spot`` of a batch as arrays; ``there`` marks real legs."""

    def __init__(self, batch: pa.RecordBatch):
        legs = batch.column("legs")
        n = pc.fill_null(pc.list_value_length(legs), 0).to_numpy(zero_copy_only=False)
        self.there = np.arange(n.max(initial=0)) < n[:, None]
        flat, names = legs.flatten(), {f.name for f in legs.type.value_type}

        def pad(values, fill):
            out = np.full(self.there.shape, fill)
            out[self.there] = values
            return out

        def equal(field, text):
            return pc.fill_null(pc.equal(flat.field(field), text), False).to_numpy(zero_copy_only=False)

        self.future = pad(equal("opt_type", "FUT"), False)
        self.call, self.put = pad(equal("opt_type", "CE"), False), pad(equal("opt_type", "PE"), False)
        self.sign = pad(np.where(equal("side", "BUY"), 1e0, -1e0), 0e0)
        self.strike, self.premium, self.units = (pad(numbers(flat.field(f)), np.nan) for f in ("strike", "premium", "units"))
        self.vol, self.days = (pad(numbers(flat.field(f)), np.nan) if f in names else None for f in ("iv", "leg_days"))
        self.spot = numbers(batch.column("spot"))
        self.option = self.there & ~self.future

    def rows(self, at) -> Legs:
        out = object.__new__(Legs)
        out.__dict__ = {k: v if v is None else v[at] for k, v in self.__dict__.items()}
        return out

    def strikes(self) -> np.ndarray:
        return np.where(self.option, self.strike, np.nan)

    def entries(self) -> np.ndarray:
        return np.where(self.future & (self.premium > 0), self.premium, np.nan)

    def far(self) -> np.ndarray:
        """A price beyond every kink."""
        kinks = np.fmax.reduce(np.concatenate([self.strikes(), self.entries(), np.zeros((len(self.spot), 1))], axis=1), axis=1)
        return np.fmax(self.spot, kinks) * 3 + 1e1

    def total(self, s: np.ndarray, value) -> np.ndarray:
        """P&L at prices ``s`` with ``value(j, rows, s)`` per unit of leg ``j``; legs are added in their order."""
        out = np.zeros(s.shape)
        for j in range(self.there.shape[1]):
            rows = np.flatnonzero(self.there[:, j])
            if len(rows) == len(s):
                out += self.sign[:, j, None] * (value(j, rows, s) - self.premium[:, j, None]) * self.units[:, j, None]
            elif len(rows):
                out[rows] += self.sign[rows, j, None] * (value(j, rows, s[rows]) - self.premium[rows, j, None]) * self.units[rows, j, None]
        return out

    def intrinsic(self, j: int, rows: np.ndarray, s: np.ndarray) -> np.ndarray:
        turn = np.where(self.call[rows, j], 1e0, -1e0)[:, None]
        return np.fmax(turn * (s - self.strike[rows, j, None]), 0e0)

    def expiry_value(self, j: int, rows: np.ndarray, s: np.ndarray) -> np.ndarray:
        fut = self.future[rows, j]
        if not fut.any():
            return self.intrinsic(j, rows, s)
        return np.where(fut[:, None], s, self.intrinsic(j, rows, s))

    def at_expiry(self, s: np.ndarray) -> np.ndarray:
        return self.total(s, self.expiry_value)

    def at_horizon(self, s: np.ndarray, horizon: np.ndarray, rate: float) -> np.ndarray:
        """A leg that expires behind the horizon keeps its model value for the remaining days."""

        def value(j, rows, s):
            out = self.expiry_value(j, rows, s)
            t, v, k = ((self.days[rows, j] - horizon[rows]) / 3.65e2), self.vol[rows, j] / 1e2, self.strike[rows, j]
            live = np.flatnonzero(~self.future[rows, j] & (t > 1e-9) & (v > 0) & (k > 0))
            if len(live):
                t, v, k, call, x = t[live, None], v[live, None], k[live, None], self.call[rows[live], j, None], s[live]
                with np.errstate(all="ignore"):
                    d1 = (np.log(x / k) + (rate + v * v / 2) * t) / (v * np.sqrt(t))
                    n1, n2, disc = _np_cdf(d1), _np_cdf(d1 - v * np.sqrt(t)), k * np.exp(-rate * t)
                    model = np.where(call, x * n1 - disc * n2, disc * (1 - n2) - x * (1 - n1))
                out[live] = np.where(x > 0, model, out[live])
            return out

        return self.total(s, value)


def slices(n: int, width: int):
    """Ranges over ``n`` rows of ``width`` cells each, ``CELLS`` at most unless one row holds more."""
    step = max(1, CELLS // max(width, 1))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def distinct(points: np.ndarray) -> np.ndarray:
    """Every row ascending and without repeats, NaN behind."""
    p = np.sort(points, axis=1)
    p[:, 1:][p[:, 1:] == p[:, :-1]] = np.nan
    return np.sort(p, axis=1)


def curve(legs: Legs, points: int) -> np.ndarray:
    """P&L at points + 1 evenly spaced prices; the window reaches down to 0 when the payoff still slopes there."""
    slope = np.where(legs.put, -legs.sign * legs.units, np.where(legs.future, legs.sign * legs.units, 0e0)).sum(axis=1)
    k = legs.strikes()
    lo = np.where(np.abs(slope) > 1e-9, 0e0, np.fmin(legs.spot * 7e-1, np.fmin.reduce(k, axis=1)) * 9.5e-1)[:, None]
    hi = (np.fmax(legs.spot * 1.3e0, np.fmax.reduce(k, axis=1)) * 1.05e0)[:, None]
    return legs.at_expiry(lo + (hi - lo) * np.arange(points + 1) / float(points))


def _sgn(v):
    return (v > 1e-9).astype(np.int8) - (v < -1e-9)


def breakevens(legs: Legs) -> tuple[np.ndarray, np.ndarray]:
    """(counts per structure, its zero crossings in ascending order): inside segments, and at kinks where the sign flips."""
    n = len(legs.spot)
    pts = np.concatenate([np.zeros((n, 1)), legs.spot[:, None], legs.far()[:, None], legs.strikes(), legs.entries()], axis=1)
    s = distinct(np.where(pts >= 0, pts, np.nan))
    v = legs.at_expiry(s)
    with np.errstate(all="ignore"):
        cross = np.where(v[:, :-1] * v[:, 1:] < 0, s[:, :-1] + (s[:, 1:] - s[:, :-1]) * (-v[:, :-1]) / (v[:, 1:] - v[:, :-1]), np.nan)
        side = _sgn(legs.at_expiry((s[:, :-1] + s[:, 1:]) / 2))  # one sign per segment
        kink = np.where((np.abs(v[:, 1:-1]) <= 1e-9) & (side[:, :-1] * side[:, 1:] < 0), s[:, 1:-1], np.nan)
        found = distinct(np.floor(np.concatenate([cross, kink], axis=1) * 1e2 + 5e-1) / 1e2)
        found[np.all((np.abs(v) < 1e-9) | np.isnan(s), axis=1)] = np.nan
    there = ~np.isnan(found)
    return there.sum(axis=1), found[there]


class Horizon:
    """Structures of several expiries at their nearest one."""

    def __init__(self, legs: Legs, points: int, rate: float):
        self.legs, self.points, self.rate = legs, points, rate
        self.horizon = np.fmin.reduce(np.where(legs.option, legs.days, np.nan), axis=1)
        self.far = legs.far()
        self.lo = self.far * 1e-6

    def at(self, s: np.ndarray) -> np.ndarray:
        return self.legs.at_horizon(s, self.horizon, self.rate)

    def grid(self) -> np.ndarray:
        """Evenly spaced prices and every strike, ascending, NaN behind."""
        lo, far = self.lo[:, None], self.far[:, None]
        s = np.concatenate([lo + (far - lo) * np.arange(self.points + 1) / float(self.points), self.legs.strikes()], axis=1)
        return distinct(np.where(s > 0, s, np.nan))

    def extremes(self, stages: int, cuts: int) -> list[np.ndarray]:
        """max_profit, at_max, max_loss, at_min."""
        s, out, rows = self.grid(), [], np.arange(len(self.far))
        v, step = self.at(s), (self.far - self.lo) / float(self.points)

        def best(s, v, turn):  # the first of the highest: the smallest price
            at = np.argmax(np.where(np.isnan(v), -np.inf, turn * v), axis=1)
            return s[rows, at], v[rows, at]

        for turn in (1e0, -1e0):
            where, seen = best(s, v, turn)
            a, b, z = np.fmax(self.lo, where - step), where + step, where
            for _ in range(stages):
                c = a[:, None] + (b - a)[:, None] * np.arange(cuts + 1) / float(cuts)
                z, pnl = best(c, self.at(c), turn)
                width, better = (b - a) / float(cuts), turn * pnl > turn * seen
                a, b = np.fmax(a, z - width), np.fmin(b, z + width)
                seen, where = np.where(better, pnl, seen), np.where(better, z, where)
            out += [seen, where]
        return out
