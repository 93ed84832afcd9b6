"""XXH64 of many byte ranges at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Fixed values of the public algorithm.
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def words_at(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian 32- and 64-bit words that begin at each byte; ``buffer`` needs 8 bytes to spare at its end."""
    two = buffer[:-1].astype(np.uint64)
    two |= buffer[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    return four, eight


def hash_ranges(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of buffer[start : start + length]."""
    four, eight = words_at(np.concatenate([buffer, np.zeros(8, np.uint8)]))
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed64 + P5, np.uint64)
        at = starts.astype(np.int64)
        left = lengths.astype(np.int64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            stripes = left[long] // 32
            acc = [np.full(len(long), x, np.uint64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            for step in range(int(stripes.max())):
                on = np.flatnonzero(stripes > step)
                place = at[long[on]] + 32 * step
                for i in range(4):
                    acc[i][on] = _round(acc[i][on], eight[place + 8 * i])
            joined = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for x in acc:
                joined = (joined ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[long] = joined
            at[long] += 32 * stripes
            left[long] -= 32 * stripes
        h += lengths.astype(np.uint64)
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            if not len(on):
                break
            place = at[on]
            h[on] = _rotl(h[on] ^ _round(np.uint64(0), eight[place]), 27) * P1 + P4
            at[on] = place + 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        if len(on):
            place = at[on]
            h[on] = _rotl(h[on] ^ ((four[place] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at[on] = place + 4
            left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left >= 1)
            if not len(on):
                break
            place = at[on]
            h[on] = _rotl(h[on] ^ (buffer[place].astype(np.uint64) * P5), 11) * P1
            at[on] = place + 1
            left[on] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
