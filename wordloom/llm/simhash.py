"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits for each seed; a bit is 1 if it is set in over half of the XXH64 hashes of the text's word
shingles (repeats included). Equal fingerprints are one class. Classes link at `distance` or fewer
differing bits: the fingerprint is cut into segments, each with a radius of 0 or 1, so that two
linked fingerprints agree in some segment up to its radius. Each segment has a table by its value,
dealt over tasks by the value's leading bits; a probe enumerates the Hamming ball of its value,
fetches the table's matches and verifies complete distances. A task returns only a spanning forest
of its links, so large groups never become all their pairs; a part too large for a task is cut into blocks.

Defined results: null and wordless texts have fingerprint zero, linked like any other; a text of
fewer words than a shingle is one shingle; a repeated doc_id keeps its rows; a row without an id links
like any other and gets the smallest id of its component, null if there is none; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_out
from .components import components
from .xxh import xxh64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Pairs whose distances a task verifies at once.
CHUNK = 1 << 21
#: Rows of a table part that a task takes.
CELL_ROWS = 1 << 20
#: Ids are below this.
NO_ID = 1 << 62


def shingle_spans(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, lower-cased and joined by single spaces, as one buffer; starts, lengths and text of its k-word shingles."""
    raw = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    gap = SPACE[raw]
    first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    stop = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    keep = ~gap
    keep[stop] = True  # the one space after each word
    shift = np.cumsum(keep) - 1
    buf = raw[keep]
    buf[shift[stop]] = 32
    ws, we = shift[first], shift[stop - 1] + 1
    owner = np.searchsorted(ends, first, side="right")
    n = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    per = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    text = np.repeat(np.arange(len(texts)), per)
    at = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    last = at + np.minimum(k, n[text]) - 1
    return buf, ws[at], we[last] - ws[at], text


def fingerprints(texts: list[bytes], k: int, seeds: tuple[int, ...] = (42,)) -> np.ndarray:
    """One row of 64-bit words, a word for each seed, for each text."""
    buf, starts, lens, text = shingle_spans(texts, k)
    return majorities(xxh64(buf, starts, lens, seeds[0]), text, len(texts), seeds)


def majorities(base: np.ndarray, text: np.ndarray, texts: int, seeds: tuple[int, ...]) -> np.ndarray:
    """The fingerprints of so many texts from their shingles' hashes with the first seed; text is the owner, ascending."""
    out = np.zeros((texts, len(seeds)), np.uint64)
    n = np.bincount(text, minlength=texts)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    bounds = np.searchsorted(text, some)
    cuts = [0]  # texts whose bits are unpacked together
    for i in range(len(some)):
        if (bounds[i] - bounds[cuts[-1]]) > 400_000:
            cuts.append(i)
    cuts.append(len(some))
    for s in range(len(seeds)):
        if s == 0:
            h = base
        else:  # further words are a strong mix of the first hash
            with np.errstate(over="ignore"):
                h = (base ^ np.uint64(seeds[s] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(33)
                h *= np.uint64(0xC4CEB9FE1A85EC53)
                h ^= h >> np.uint64(29)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            lo = bounds[a]
            hi = bounds[b] if b < len(some) else len(text)
            bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, bounds[a:b] - lo, axis=0, dtype=np.int32)
            over = (2 * ones > n[some[a:b], None]).astype(np.uint8)
            out[some[a:b], s] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_rows(docs: DataFrame, k: int, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (XXH64 of the text) and fp (array of long words) of every row, in batches of bounded bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(ids: list, keys: list, texts: list) -> pd.DataFrame:
            fp = fingerprints(texts, k, seeds).view(np.int64)
            return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "text_key": keys, "fp": list(fp)})

        for frame in batches:
            ids, keys, texts, held = [], [], [], 0
            for i, x, t in zip(frame["doc_id"], frame["text_key"], frame["text"]):
                ids.append(None if pd.isna(i) else int(i))
                keys.append(x)
                texts.append(bytes(t) if t is not None else b"")
                held += len(texts[-1])
                if held > 4_000_000:
                    yield out(ids, keys, texts)
                    ids, keys, texts, held = [], [], [], 0
            if ids:
                yield out(ids, keys, texts)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_key"))
    return picked.mapInPandas(run, "doc_id long, text_key long, fp array<long>")


@dataclass(frozen=True)
class Scheme:
    """words of a fingerprint, largest distance, and segments (first bit, bits, radius) whose radii leave no linked pair out."""

    words: int
    distance: int
    segments: tuple[tuple[int, int, int], ...]


#: 4 differing bits cannot be 2 or more in both of two segments and 1 or more in a third.
CONTRACT = Scheme(1, 4, ((0, 21, 1), (21, 21, 1), (42, 22, 0)))


def _value(fp: np.ndarray, segment: tuple[int, int, int]) -> np.ndarray:
    """The segment's value in each fingerprint; a segment stays inside one word."""
    bit, width, _ = segment
    return (fp[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64((1 << width) - 1)


def _links(ids: np.ndarray, fp: np.ndarray, key: np.ndarray, guest: np.ndarray, low_bits: int, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (id, smaller id) of the links that one table part sees; guests only probe."""
    own = np.flatnonzero(~guest)
    order = own[np.argsort(key[own], kind="stable")]
    sorted_keys = key[order]
    label = np.arange(len(ids))

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        while len(a):
            la, lb = label[a], label[b]
            m = np.minimum(la, lb)
            np.minimum.at(label, la, m)
            np.minimum.at(label, lb, m)
            while not np.array_equal(nxt := label[label], label):
                label = nxt
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]

    def probe(who: np.ndarray, wanted: np.ndarray, same: bool) -> None:
        lo = np.searchsorted(sorted_keys, wanted, "left")
        hi = np.searchsorted(sorted_keys, wanted, "right")
        if same:  # pairs of one value once: only what stands later
            lo = np.arange(len(who)) + 1
        n = np.maximum(hi - lo, 0)
        live = np.flatnonzero(n)
        done = 0
        total = np.cumsum(n[live])
        while done < len(live):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CHUNK, "right")))
            part = live[done:upto]
            done = upto
            for off in range(0, int(n[part].max()), CHUNK) if len(part) == 1 else (0,):
                k = np.minimum(n[part] - off, CHUNK) if len(part) == 1 else n[part]
                a = np.repeat(who[part], k)
                b = order[np.repeat(lo[part] + off, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                near = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1) <= distance
                merge(a[near], b[near])

    probe(order, sorted_keys, True)
    if radius:
        for bit in range(low_bits):
            flip = np.uint64(1 << bit)
            who = order[(sorted_keys & flip) == 0]
            probe(who, key[who] | flip, False)
        who = np.flatnonzero(guest)
        probe(who, key[who], False)
    child = np.flatnonzero(label != np.arange(len(ids)))
    return ids[child], ids[label[child]]


def near_links(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) whose transitive closure joins all classes (doc_id, fp; one row for each fp) within the distance."""
    spark = classes.sparkSession
    count = classes.count()
    lead = max(2, int(np.ceil(np.log2(max(count, 1) / 60_000 + 1))))  # leading bits: a table part holds about 2**16 classes
    words = scheme.words

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each class to its part of each table, and as a guest to the parts one leading bit away."""
        for frame in batches:
            if not len(frame):
                continue
            fp = np.stack(frame["fp"].to_numpy()).view(np.uint64).reshape(len(frame), words)
            ids = frame["doc_id"].to_numpy(np.int64)
            packed = np.concatenate([ids[:, None].view(np.uint64), fp], axis=1)
            for t, (bit, width, radius) in enumerate(scheme.segments):
                bits = min(lead, width)
                part = (_value(fp, (bit, width, radius)) >> np.uint64(width - bits)).astype(np.int64)
                sent = [(part, np.zeros(len(part), bool), np.arange(len(part)))]
                for j in range(bits if radius else 0):
                    zero = np.flatnonzero((part >> j & 1) == 0)
                    sent.append((part[zero] | 1 << j, np.ones(len(zero), bool), zero))
                to = np.concatenate([s[0] for s in sent])
                guest = np.concatenate([s[1] for s in sent])
                row = np.concatenate([s[2] for s in sent])
                order = np.lexsort((guest, to))
                to, guest, row = to[order], guest[order], row[order]
                edge = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (guest[1:] != guest[:-1]), [True]]))
                yield pd.DataFrame({
                    "cell": [t << 20 | int(to[a]) for a in edge[:-1]],
                    "guest": [bool(guest[a]) for a in edge[:-1]],
                    "n": np.diff(edge),
                    "data": [packed[row[a:b]].tobytes() for a, b in zip(edge[:-1], edge[1:])],
                })

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        cell = int(frame["cell"].iloc[0])
        bit, width, radius = scheme.segments[cell >> 20]
        bits = min(lead, width)
        rows = [np.frombuffer(d, np.uint64).reshape(-1, words + 1) for d in frame["data"]]
        guest = np.repeat(frame["guest"].to_numpy(bool), [len(r) for r in rows])
        rows = np.concatenate(rows)
        order = np.argsort(rows[:, 0], kind="stable")  # smaller ids become the roots
        rows, guest = rows[order], guest[order]
        fp = np.ascontiguousarray(rows[:, 1:])
        key = _value(fp, (bit, width, radius))
        low = width - bits
        top = np.uint64(cell & 0xFFFFF) << np.uint64(low)
        key = (key & np.uint64((1 << low) - 1)) | top  # a guest probes with its one leading bit flipped
        a, b = _links(rows[:, 0].view(np.int64), fp, key, guest, low, radius, scheme.distance)
        return pd.DataFrame({"a": a, "b": b})

    dealt = dealt_out(classes.mapInPandas(deal, "cell long, guest boolean, n long, data binary"), CELL_ROWS)
    return dealt.groupBy("cell", "block").applyInPandas(match, "a long, b long")


def near_groups(docs: DataFrame, k: int, scheme: Scheme, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fp and component_id (smallest doc_id reachable over links) of every row."""
    rows = cut(fingerprint_rows(docs, k, seeds, id_col, text_col))
    # A class without any id stands behind all ids, so that it joins others but names no component.
    stand_in = F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(NO_ID))
    classes = cut(rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), stand_in).alias("doc_id")))
    roots = components(near_links(classes, scheme))
    root = F.coalesce("root", "doc_id")
    named = classes.join(roots, classes.doc_id == roots.node, "left").select("fp", F.when(root < NO_ID, root).alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "text_key", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: four-word shingles, one word of bits, at most 4 differing."""
    out = near_groups(docs, 4, CONTRACT)
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.element_at("fp", 1))), 16, "0").alias("fingerprint"), "component_id")
