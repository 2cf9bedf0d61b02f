"""Sampled suffixes of byte texts: rolling gram hashes, window minimizers and their contexts."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: A second, independent base and table: with both, a window's identifier has 128 bits.
BASE2 = 0xD6E8FEB86659FD93
TABLE2 = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def gram_ids(buf: np.ndarray, q: int, table: np.ndarray = TABLE, base: int = BASE) -> np.ndarray:
    """The bucket identifier (64-bit polynomial hash) of the q bytes from each offset of buf."""
    with np.errstate(over="ignore"):
        power, width, out, have = table[buf], 1, None, 0
        while True:
            if q & width:
                if out is None:
                    out = power
                else:  # what is gathered so far covers `have` bytes; the next part stands behind it
                    n = len(power) - have
                    out = out[:n] * np.uint64(pow(base, width, 2**64)) + power[have : have + n]
                have += width
            if have == q:
                return out
            n = len(power) - width
            if n <= 0:
                return np.zeros(0, np.uint64)
            power = power[:n] * np.uint64(pow(base, width, 2**64)) + power[width : width + n]
            width *= 2


def window_ids(grams: np.ndarray, n: int, length: int, q: int) -> np.ndarray:
    """Identifiers of the n windows: a window's bucket, refined by the buckets at later offsets."""
    with np.errstate(over="ignore"):
        h = mixed(grams[:n])
        for s in [*range(q, length - q, q), length - q]:
            h = mixed(h * np.uint64(5) + grams[s : s + n])
    return h


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of x[i:i+w] for each i."""
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Samples:
    """The suffixes of a batch of texts that a window of `length` bytes is assigned to.

    Each window belongs to the leftmost place of its smallest q-gram. gram: the place's bucket;
    context: identifies the bytes of all windows it owns; first, count: those windows' starts.
    windows and checks: two independent identifiers of each window, the second on demand.
    """

    def checks(self) -> np.ndarray:
        if len(self.buf) < self.length:
            return np.zeros(0, np.uint64)
        return window_ids(gram_ids(self.buf, self.q, TABLE2, BASE2), len(self.buf) - self.length + 1, self.length, self.q)

    def __init__(self, texts: list[bytes], length: int, q: int) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        buf = np.frombuffer(b"".join(texts), np.uint8)
        self.buf, self.length, self.q = buf, length, q
        w = length - q + 1
        empty = np.zeros(0, np.int64)
        if len(buf) < length:
            self.windows = np.zeros(0, np.uint64)
            self.doc, self.first, self.count, self.gram, self.context = empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        grams = gram_ids(buf, q)
        n = len(buf) - length + 1
        self.windows = h = window_ids(grams, n, length, q)
        order = mixed(grams)
        # The smallest gram's hash; the place in the low bits makes the leftmost win and tells where it is.
        low = np.uint64(30)
        tagged = ((order >> low) << low) | np.arange(len(order), dtype=np.uint64)
        at = (window_min(tagged, w)[:n] & np.uint64((1 << 30) - 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
        start = np.concatenate([np.arange(b, b + max(0, s - length + 1)) for b, s in zip(self.begin, sizes)]) if len(texts) else empty
        p = at[start]
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])) if len(p) else empty
        count = np.diff(np.concatenate([new, [len(p)]]))
        self.doc, i = doc[new], start[new]
        self.first, self.count = i - self.begin[self.doc], count
        self.gram = order[p[new]]
        with np.errstate(over="ignore"):
            last = i + count - 1
            self.context = mixed(h[i] * np.uint64(3) + mixed(h[last]) + ((p[new] - i) * 64 + count).astype(np.uint64))
