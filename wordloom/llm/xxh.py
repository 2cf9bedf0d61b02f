"""XXH64 of many byte spans of one buffer at once."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x, r: int):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:start+len] for each span; buf holds bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    buf = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    half = np.ndarray((len(buf) - 3,), dtype="<u4", buffer=buf, strides=(1,))
    seed = np.uint64(seed)
    starts, lens = starts.astype(np.int64), lens.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed + P5, np.uint64)
        pos = starts.copy()
        long = np.flatnonzero(lens >= 32)
        if len(long):
            at, left = pos[long], lens[long] >> 5
            acc = [np.full(len(long), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], wide[at[live] + 8 * k])
                at[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            x = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for k in range(4):
                x = (x ^ _round(np.uint64(0), acc[k])) * P1 + P4
            h[long] = x
            pos[long] = at
        h += lens.astype(np.uint64)
        rest = lens & 31
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1))
            if len(i):
                h[i] = _rot(h[i] ^ _round(np.uint64(0), wide[pos[i]]), 27) * P1 + P4
                pos[i] += 8
        i = np.flatnonzero(rest & 4)
        if len(i):
            h[i] = _rot(h[i] ^ (half[pos[i]].astype(np.uint64) * P1), 23) * P2 + P3
            pos[i] += 4
        for k in range(3):
            i = np.flatnonzero((rest & 3) > k)
            if len(i):
                h[i] = _rot(h[i] ^ (buf[pos[i]].astype(np.uint64) * P5), 11) * P1
                pos[i] += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h
