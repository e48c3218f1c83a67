"""Anchors: places in a byte string that depend on nothing but the bytes around them.

Every window of WINDOW bytes has one anchor: the start of that one among its
strings of GRAM bytes whose hash is least. Neighbouring windows mostly share
it; a zone is a run of windows with one anchor. Equal windows, wherever they
stand, have equal anchors at equal distances.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 200, 100
REACH = WINDOW - GRAM + 1  # strings of GRAM bytes in a window

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: An odd base, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed in one go, which bounds what is held besides the text.
CHUNK = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]).cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CHUNK + 2 * WINDOW + 1), _powers(_INVERSE, CHUNK + 2 * WINDOW + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of ``length`` bytes in ``data``, which has CHUNK + 2 * WINDOW bytes at most."""
    n = len(data) - length + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), (_BYTE[data] * _UP[: len(data)]).cumsum(dtype=np.uint64)])
        return mixed((sums[length:] - sums[:n]) * _DOWN[:n])


_SEEN = np.zeros(1 << 18, bool)


def _again(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Those of ``values`` that occur in ``h`` twice within WINDOW places."""
    slot, shift = values >> np.uint64(46), np.uint64(46)
    _SEEN[slot] = True
    at = np.flatnonzero(_SEEN[h >> shift])
    _SEEN[slot] = False
    order = np.argsort(h[at], kind="stable")
    at, found = at[order], h[at[order]]
    return found[1:][(found[1:] == found[:-1]) & (at[1:] - at[:-1] <= WINDOW)]


def zones(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a whole text: each zone's first window, number of windows, anchor's hash, and whether windows in it can be equal.

    Equal windows that overlap by half or more may share one zone. Their anchors'
    hash then occurs twice within WINDOW places, as it does in periodic text only.
    Zones that a chunk's end cuts are put together again, so chunks do not show.
    """
    total = len(data) - WINDOW + 1  # windows
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    firsts, values, again = [], [], []
    for begin in range(0, total, CHUNK):
        windows = min(CHUNK, total - begin)
        wide = hashes(data[begin : begin + windows + 2 * WINDOW - 1], GRAM)
        h = wide[: windows + REACH - 1]
        # least of REACH neighbours: prefixes and suffixes of blocks of that length
        n = len(h)
        padded = np.full(-(-n // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = h
        blocks = padded.reshape(-1, REACH)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:windows], ahead[REACH - 1 : REACH - 1 + windows])
        # the windows where the least hash changes; equal hashes in one window count as one anchor
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], change])
        firsts.append(first + begin)
        values.append(least[first])
        again.append(_again(wide, values[-1]))
    first, value, again = np.concatenate(firsts), np.concatenate(values), np.concatenate(again)
    if len(firsts) > 1:
        keep = np.concatenate([[True], value[1:] != value[:-1]])
        first, value = first[keep], value[keep]
    twice = np.isin(value, again) if len(again) else np.zeros(len(value), bool)
    return first, np.diff(np.append(first, total)), value, twice
