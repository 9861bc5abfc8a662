"""DartMinHash: sparse weighted signatures from hashed darts.

Darts fall evenly on the plane of weight and time of every element; which, a
hash of the element decides. A document sees the darts in its elements'
regions, each as high as the element's weight. Every dart aims at one of ``k``
coordinates, and each coordinate keeps the earliest dart that it sees. Two
documents agree at a coordinate with the probability of their weighted Jaccard
similarity. A document needs about ``k (ln k + 3)`` darts, whatever its length.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _interval(cell: int, first: float) -> tuple[float, float]:
    """Dyadic cells: [0, first), [first, 2 first), [2 first, 4 first) ..."""
    return (0.0, first) if cell == 0 else (first * 2.0 ** (cell - 1), first * 2.0**cell)


def _poisson_steps(area: float) -> np.ndarray:
    """The distribution function of the number of darts in a cell."""
    n = np.arange(1, int(area + 12 * np.sqrt(area)) + 24)
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(area / n))]) - area))


def _darts(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, until: np.ndarray, k: int):
    """Owner, coordinate, time and name of the darts before ``until`` of their owner."""
    found = []
    row = 0
    while (low := _interval(row, 1.0)[0]) < weights.max(initial=0.0):
        high = _interval(row, 1.0)[1]
        # cells that are high are short, so that the first holds a quarter of a dart on average
        cell, soonest = 0, 0.25 / (high - low)
        heavy = weights > low
        latest = until[owners[heavy]].max(initial=0.0)
        while (begin := _interval(cell, soonest)[0]) < latest:
            end = _interval(cell, soonest)[1]
            some = np.flatnonzero(heavy & (until[owners] > begin))
            salt = mix(np.array([(row << 20) + cell + 1], dtype=np.uint64) * _ODD)[0]
            base = mix(elements[some] ^ salt)
            count = np.searchsorted(_poisson_steps((high - low) * (end - begin)), (base >> np.uint64(11)) * 2.0**-53)
            which = np.repeat(np.arange(len(some)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            with np.errstate(over="ignore"):
                name = mix(base[which] + (nth.astype(np.uint64) + np.uint64(1)) * _ODD)
            own = some[which]
            time = begin + (end - begin) * ((name >> np.uint64(32)) * 2.0**-32)
            fine = time < until[owners[own]]
            if row or (weights[some] < high).any():
                height = low + (high - low) * ((mix(name) >> np.uint64(32)) * 2.0**-32)
                fine &= height < weights[own]
            own, name, time = own[fine], name[fine], time[fine]
            found.append((owners[own], ((name & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64), time, name))
            cell += 1
        row += 1
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, t) for t in (np.int64, np.int64, float, np.uint64)]


def signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, count: int, k: int) -> np.ndarray:
    """``count`` rows of ``k`` dart names; zeros for owners without elements.

    ``owners`` says whose each element is. Owners that miss a coordinate look
    further ahead until they have all.
    """
    out = np.zeros((count, k), np.uint64)
    total = np.bincount(owners, weights, count)
    ahead = k * (np.log(k) + 3)
    left = total > 0
    while left.any():
        own = left[owners]
        until = np.where(left, ahead / np.maximum(total, 1e-300), 0.0)
        who, aim, time, name = _darts(elements[own], weights[own], owners[own], until, k)
        place = who * k + aim
        order = np.argsort((place.astype(np.uint64) << np.uint64(32)) | (time / np.maximum(until[who], 1e-300) * 2.0**32).astype(np.uint64))
        place, name = place[order], name[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        seen = np.zeros((count, k), bool)
        seen.ravel()[place[first]] = True
        full = seen.all(axis=1) & left
        hits = full[place[first] // k]
        out.ravel()[place[first][hits]] = name[first][hits]
        left &= ~full
        ahead *= 2
    return out
