"""Seatings of many Chinese restaurants at once.

A *group* holds the customers of one dish in one restaurant.  Given a weight for
opening a table (what the restaurant's strength, its tables and the parent's
probability of the dish make up), groups don't depend on each other, so they
are sampled together.

A group's seating is redrawn as a whole where its number of tables has few
values that matter: t tables have a chance that goes with ``weight ** t`` times
the ways to seat the customers at t tables, so one draw is what sweeps over the
customers one by one come to in the end, and nothing need settle.  The draws
that are kept take places spread evenly over that distribution.

Of a group of more than :data:`COUNTED` customers, or of too many tables, a row
of an array holds the sizes of the tables; it moves in :data:`BLOCKS` blocks of
customers drawn at random, whose members are seated side by side: the chance of
a new table is that of the block's middle, and those who share a block don't
share a new table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: The largest group whose ways are counted, and the parts in which larger ones move.
COUNTED, BLOCKS = 1024, 16
#: Numbers of tables that are looked at, where all or all that matter lie below.
WIDTHS = (4, 8, 16, 32, 64, 256)
#: Numbers in an array of tables.
CELLS = 1 << 20


@cache
def _ways(discount: float) -> np.ndarray:
    """Logarithm of the ways to seat n customers at t tables, at [n - 1, t - 1], less that of one table.

    A new customer opens a table, or joins one of t with a weight of n - discount * t.
    """
    tables = np.arange(1, WIDTHS[-1] + 1)
    out = np.full((COUNTED, len(tables)), -np.inf)
    out[0, 0] = 0.0
    for n in range(1, COUNTED):
        joined = out[n - 1] + np.log(np.maximum(n - discount * tables, 1e-300))
        joined[1:] = np.logaddexp(joined[1:], out[n - 1, :-1])
        out[n] = joined - joined[0]
    return out


def _drawn(count: np.ndarray, weight: np.ndarray, discount: float, kept: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """:func:`mean_tables` of groups of 2 to :data:`COUNTED` customers; and places of those that more tables matter to than are looked at."""
    ways, total = _ways(discount), np.zeros(len(count), np.int64)
    at, log = rng.random(len(count)), np.log(np.maximum(weight, 1e-300))
    mean = 1 + weight * np.log1p(count / (weight + 1))
    left, need = np.arange(len(count)), np.minimum(count, mean + 6 * np.sqrt(mean) + 4)
    for width in WIDTHS:
        tried, left, steps = left[need[left] <= width], [left[need[left] > width]], np.arange(1, width + 1)
        for begin in range(0, len(tried), CELLS // 4 // width):
            own = tried[begin : begin + CELLS // 4 // width]
            chance = ways[count[own] - 1, :width] + log[own, None] * steps
            chance -= chance.max(axis=1, keepdims=True)
            np.exp(chance, out=chance)
            upto = np.cumsum(chance, axis=1)
            # the chances have one peak, so a last one of next to nothing has less than that behind it
            sure = (count[own] <= width) | (chance[:, -1] <= 1e-16 * upto[:, -1])
            for k in range(kept):
                below = upto[:, :-1] <= ((at[own] + k / kept) % 1 * upto[:, -1])[:, None]
                total[own] += np.where(sure, 1 + below.sum(axis=1), 0)
            left.append(own[~sure])
        left = np.concatenate(left)
    return total, left


def _room(sizes: np.ndarray, wanted: np.ndarray | int) -> np.ndarray:
    """The array with columns for more tables where a row has fewer free ones than wanted."""
    while ((sizes == 0).sum(axis=1) < wanted).any():
        sizes = np.hstack([sizes, np.zeros_like(sizes)])
    return sizes


def _join_many(sizes: np.ndarray, more: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Seat ``more`` customers in each row side by side."""
    seated = np.where(sizes > 0, sizes - discount, 0.0)
    total = seated.sum(axis=1)
    new = np.where(total > 0, rng.binomial(more, weight / (weight + total + np.maximum(more - 1, 0) / 2)), more)
    sizes = _room(sizes, new)
    sizes[:, : seated.shape[1]] += rng.multinomial(more - new, seated / np.where(total > 0, total, 1.0)[:, None])
    free = sizes == 0
    sizes[free & (np.cumsum(free, axis=1) <= new[:, None])] = 1
    return sizes


def _ahead(steps: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, discount: float) -> list[np.ndarray]:
    """Weight of a new table at each step of a first seating.

    A table makes all who come later less likely, so it counts less the more
    are still out; how much less depends on the tables there will be, and these
    on the weights, so both are found in turns.
    """
    now = [weight] * len(steps)
    for _ in range(4):
        tables, left = np.ones(len(weight)), []
        for w, (seated, more) in zip(now, steps, strict=True):
            mass = w + seated + np.maximum(more - 1, 0) / 2 - discount * tables
            left.append(more / mass)
            tables = tables + more * w / mass
        after = np.zeros(len(weight))
        for k in range(len(steps) - 1, -1, -1):
            now[k] = weight * np.exp(-discount * after)
            after = after + left[k]
    return now


def _seat_first(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Seat all customers as they come, from an empty restaurant; a fifth of those seated at a time."""
    sizes = np.zeros((len(count), 2), np.int64)
    sizes[:, 0] = 1
    steps, seated = [], np.ones(len(count), np.int64)
    while (seated < count).any():
        steps.append((seated, np.minimum(count - seated, np.maximum(1, seated // 5))))
        seated = seated + steps[-1][1]
    for w, (_, more) in zip(_ahead(steps, weight, discount), steps, strict=True):
        sizes = _join_many(sizes, more, w, discount, rng)
    return sizes


def _sweep(sizes: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    for _ in range(BLOCKS):
        gone = rng.binomial(sizes, 1 / BLOCKS)
        sizes -= gone
        sizes = _join_many(sizes, gone.sum(axis=1), weight, discount, rng)
    return sizes


def _alike(count: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of groups that are sampled together: of about as many tables."""
    tables = np.minimum(count, 1 + weight * np.log1p(count / (weight + 1)))
    order = np.argsort(tables, kind="stable")
    kind = np.ceil(np.log2(tables[order] + 3) / 2)
    for part in np.split(order, np.flatnonzero(np.diff(kind)) + 1):
        wide = max(1, int(CELLS // max(8, 2 * tables[part].max(), 4 * np.log(count[part].max()))))
        for at in range(0, len(part), wide):
            yield part[at : at + wide]


def mean_tables(count: np.ndarray, weight: np.ndarray, discount: float, sweeps: int, kept: int, rng: np.random.Generator) -> np.ndarray:
    """Sum over the last ``kept`` of ``sweeps`` sweeps of the number of tables of each group (int64).

    ``count`` is the number of customers, ``weight`` that of a new table.  A
    group of one customer has one table.
    """
    out = np.where(count > 0, kept, 0).astype(np.int64)
    large = np.flatnonzero(count > COUNTED)
    drawn = np.flatnonzero((count > 1) & (count <= COUNTED))
    if len(drawn):
        out[drawn], left = _drawn(count[drawn], weight[drawn], discount, kept, rng)
        large = np.append(large, drawn[left])
    for part in _alike(count[large], weight[large]) if len(large) else ():
        own = large[part]
        n, w = count[own], weight[own]
        sizes, total = _seat_first(n, w, discount, rng), np.zeros(len(own), np.int64)
        for sweep in range(sweeps):
            sizes = _sweep(sizes, w, discount, rng)
            if sweep >= sweeps - kept:
                total += (sizes > 0).sum(axis=1)
        out[own] = total
    return out
