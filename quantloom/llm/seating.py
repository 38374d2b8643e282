"""Seating customers in Pitman-Yor restaurants: Gibbs draws of the tables of each dish.

A restaurant's dish with c customers at t tables has, given all other dishes, the probability

    S(c, t) * product over its tables of (concentration + discount * tables before) * (parent's probability)

where S counts the ways to seat c customers at t tables, each weighed by its discounted table sizes
(generalised Stirling numbers). A draw of t from this distribution seats all customers of the dish
at once. Up to ``LISTED`` customers the distribution is exact. Beyond, S(c, t + 1) / S(c, t) is taken at
its saddle point, whose error falls with c (tests compare); few tables are drawn from the distribution
so listed, many from the normal distribution of the same mode and curvature.
"""

from __future__ import annotations

import functools

import numpy as np

#: Customers of a dish up to which every number of tables is listed.
LISTED = 64
#: Dishes of a restaurant are redrawn in this many turns; those of one turn know each other's tables as before the turn.
TURNS = 8
_BINS = (2, 3, 4, 8, 16, 32, 64)
#: Customers of a dish up to which weights are multiplied as they are; beyond, their logarithms are added.
_PLAIN = 8


@functools.lru_cache(maxsize=4)
def log_ways(discount: float, most: int = LISTED) -> np.ndarray:
    """log S(c, t) for c and t up to ``most``, by S(c + 1, t) = S(c, t - 1) + (c - discount * t) * S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(most):
            stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, 1:]
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def discount_of(customers: np.ndarray) -> float:
    """From the numbers of dishes with one and with two customers."""
    one, two = int((customers == 1).sum()), int((customers == 2).sum())
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5


def concentration_of(now: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> float:
    """A Gibbs draw of the concentration given restaurants' customers and tables, under a Gamma(1, 1) prior."""
    some = tables > 1
    if not some.any():
        return float(rng.gamma(1.0))
    more = np.sort(tables[some]) - 1
    i = np.arange(1, int(more[-1]) + 1)
    with_more = len(more) - np.searchsorted(more, i)
    old = rng.binomial(with_more, now / (now + discount * i)).sum()
    left = np.log(rng.beta(now + 1, customers[some] - 1)).sum()
    return float(max(rng.gamma(1.0 + old) / (1.0 - left), 1e-3))


def _weights(i: np.ndarray, opening: np.ndarray, discount: float, num: np.ndarray, den: np.ndarray, step: float) -> np.ndarray:
    """log of the weight of one more table when the dish has i."""
    return np.log((opening + discount * i) * ((num + step * i) / (den + step * i)))


def _listed(customers: np.ndarray, ways: np.ndarray, opening: np.ndarray, discount: float, num: np.ndarray, den: np.ndarray, step: float, rng: np.random.Generator) -> np.ndarray:
    """A row per number of tables, so that each step runs along all dishes at once."""
    most = int(customers.max())
    if most <= _PLAIN:
        p = np.exp(ways[: most + 1, 1 : most + 1].T)[:, customers]
        weight = np.ones(len(customers))
        for i in range(1, most):
            weight *= (opening + discount * i) * ((num + step * i) / (den + step * i))
            p[i] *= weight
    else:
        p = np.ascontiguousarray(ways[: most + 1, 1 : most + 1].T)[:, customers]
        p[1:] += np.cumsum(_weights(np.arange(1, most)[:, None], opening, discount, num, den, step), axis=0)
        p -= p.max(axis=0)
        np.exp(p, out=p)
    for i in range(1, most):
        p[i] += p[i - 1]
    return 1 + (p < rng.random(len(customers)) * p[-1]).sum(axis=0)


@functools.lru_cache(maxsize=4)
def _saddle(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(log of customers per table, log g) along the saddle points x = 1 - exp(-z).

    S(c, t) is c!/t! times the coefficient of x**c in g(x)**t with g(x) = (1 - (1 - x)**discount) / discount,
    whose saddle point depends on c / t = x g'(x) / g(x) only.
    """
    z = np.geomspace(1e-9, 40 / (1 - discount) + 40, 8192)
    g = np.log(-np.expm1(-discount * z) / discount)
    return np.log(-np.expm1(-z)) - (discount - 1) * z - g, g


def _smooth(customers: np.ndarray, opening: np.ndarray, discount: float, num: np.ndarray, den: np.ndarray, step: float, rng: np.random.Generator) -> np.ndarray:
    ratio, g = _saddle(discount)
    size = np.log(customers.astype(float))

    def more(t: np.ndarray, k=slice(None), add: tuple = (), log: np.ndarray | None = None) -> np.ndarray:
        """log P(t + 1) - log P(t) of dishes ``k``; ``log`` is that of ``t`` where it is known."""
        c, o, a, b = (x[k][add] if add else x[k] for x in (size, opening, num, den))
        log = np.log(t) if log is None else log
        return np.interp(c - log, ratio, g) - log + _weights(t, o, discount, a, b, step)

    low, high = np.zeros(len(customers)), size
    for _ in range(28):
        middle = (low + high) / 2
        up = more(np.exp(middle), log=middle) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    t = np.exp((low + high) / 2)
    curve = (more(t * 0.999) - more(t * 1.001)) / (0.002 * t)
    out = np.rint(t + 0.5 + rng.standard_normal(len(t)) / np.sqrt(np.maximum(curve, 1e-12))).astype(np.int64)
    few = np.flatnonzero(t < _BINS[-1] / 2)
    if len(few):  # so few tables that their distribution is listed
        log = more(np.arange(1.0, 2 * _BINS[-1]), few, (slice(None), None))
        p = np.exp(np.cumsum(np.hstack((np.zeros((len(few), 1)), log)), axis=1) - np.maximum(np.cumsum(log, axis=1).max(axis=1), 0)[:, None])
        np.cumsum(p, axis=1, out=p)
        out[few] = 1 + (p < (rng.random(len(p)) * p[:, -1])[:, None]).sum(axis=1)
    return np.clip(out, 1, customers)


def _binned(customers: np.ndarray, turn: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order of dishes by turn and then by the bin of their customers, bounds of each bin of each turn in it)."""
    bins = len(_BINS) + 1
    key = (turn * bins + np.searchsorted(_BINS, customers)).astype(np.uint8)
    counts = np.bincount(key, minlength=bins * TURNS)
    return np.argsort(key, kind="stable"), np.concatenate(([0], np.cumsum(counts)))


def tables_of(
    customers: np.ndarray, opening: np.ndarray, discount: float, num: np.ndarray, den: np.ndarray, step: float, ways: np.ndarray, rng: np.random.Generator, cuts: np.ndarray | None = None
) -> np.ndarray:
    """A draw of each dish's number of tables, for dishes of two customers or more.

    ``opening`` is the concentration plus discount times the tables of the restaurant's other dishes. The
    parent's probability of the dish is (num + step * i) / (den + step * i) once i tables have sent a
    customer there: with ``step`` 1 it counts them, with 0 the parent is held still. ``cuts`` are the bounds
    of ``_BINS`` if dishes are in their order.
    """
    if cuts is None:
        order, cuts = _binned(customers)
        out = np.empty(len(customers), np.int64)
        out[order] = tables_of(customers[order], opening[order], discount, num[order], den[order], step, ways, rng, cuts)
        return out
    out = np.empty(len(customers), np.int64)
    for bin_ in range(len(_BINS) + 1):
        k = slice(int(cuts[bin_]), int(cuts[bin_ + 1]))
        if k.start < k.stop:
            if bin_ < len(_BINS):
                out[k] = _listed(customers[k], ways, opening[k], discount, num[k], den[k], step, rng)
            else:
                out[k] = _smooth(customers[k], opening[k], discount, num[k], den[k], step, rng)
    return out


def turns_of(group: np.ndarray) -> np.ndarray:
    """The turn of each dish: its place among its group's, modulo ``TURNS``."""
    if not len(group):
        return group
    order = np.argsort(group, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return place % TURNS


class Level:
    """Dishes of restaurants of one level: customers, tables, and the restaurants' totals."""

    def __init__(self, customers: np.ndarray, group: np.ndarray, groups: int) -> None:
        self.customers, self.group = customers.astype(np.int64), group
        self.tables = (self.customers > 0).astype(np.int64)
        self.groups, self.concentration, self._turns = groups, 1.0, None
        self.recount()

    def recount(self) -> None:
        self.total = np.bincount(self.group, self.customers, self.groups).astype(np.int64)
        self.opened = np.bincount(self.group, self.tables, self.groups).astype(np.int64)
        self.discount = discount_of(self.customers)

    def draw_concentration(self, rng: np.random.Generator) -> None:
        self.concentration = concentration_of(self.concentration, self.discount, self.total, self.opened, rng)

    def predicted(self, parent: np.ndarray) -> np.ndarray:
        """Each dish's probability in its restaurant, given the parent's."""
        opening = (self.concentration + self.discount * self.opened)[self.group]
        return (self.customers - self.discount * self.tables + opening * parent) / (self.concentration + self.total)[self.group]

    def turns(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(dishes by bins, bounds of bins) of each turn."""
        able = np.flatnonzero(self.customers > 1)
        order, cuts = _binned(self.customers[able], turns_of(self.group[able]))
        able, bins = able[order], len(_BINS) + 1
        starts = range(0, bins * TURNS, bins)
        return [(able[cuts[k] : cuts[k + bins]], cuts[k : k + bins + 1] - cuts[k]) for k in starts if cuts[k] < cuts[k + bins]]

    def turns_kept(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """``turns``, made once: for a level whose customers stay."""
        if self._turns is None:
            self._turns = self.turns()
        return self._turns

    def place(self, k: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Give dishes ``k`` new tables; returns the change of each."""
        change = tables - self.tables[k]
        self.tables[k] = tables
        np.add.at(self.opened, self.group[k], change)
        return change

    def sweep(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        """Redraw all dishes under a parent that is held still."""
        ways = log_ways(self.discount)
        for k, cuts in self.turns():
            opening = self.concentration + self.discount * (self.opened[self.group[k]] - self.tables[k])
            self.place(k, tables_of(self.customers[k], opening, self.discount, parent[k], np.ones(len(k)), 0.0, ways, rng, cuts))
        self.draw_concentration(rng)


def two_levels(upper: Level, lower: Level, of: np.ndarray, root: np.ndarray, rng: np.random.Generator) -> None:
    """One Gibbs sweep of ``lower``'s dishes and then of ``upper``'s, which get a customer per table of ``lower``.

    ``of`` is the dish of ``upper`` that each dish of ``lower`` sends to, and ``root`` the probability of
    each dish of ``upper`` in the level above. A dish of ``lower`` is redrawn with the customers that it has
    sent taken back, and each new table sees those that its tables before it have sent.
    """
    ways = log_ways(lower.discount)
    for k, cuts in lower.turns_kept():
        own, q = lower.tables[k], of[k]
        others = upper.customers[q] - own
        kept = np.maximum(np.minimum(upper.tables[q], others), 1)
        head = upper.group[q]
        num = others - upper.discount * kept + (upper.concentration + upper.discount * upper.opened[head]) * root[q]
        den = upper.concentration + upper.total[head] - own
        opening = lower.concentration + lower.discount * (lower.opened[lower.group[k]] - own)
        change = lower.place(k, tables_of(lower.customers[k], opening, lower.discount, num, den, 1.0, ways, rng, cuts))
        np.add.at(upper.customers, q, change)
        np.add.at(upper.total, head, change)
    lower.draw_concentration(rng)
    upper.tables = np.minimum(np.maximum(upper.tables, upper.customers > 0), upper.customers)
    upper.recount()
    upper.sweep(root, rng)
