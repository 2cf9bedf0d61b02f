"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id. Suffixes are put into initial buckets by their first `q` bytes; a bucket is refined by the
buckets at later offsets (q, length - q), which gives the bucket of all `length` bytes. Only
suffixes at window minimizers are bucketed (a shared window has its minimizer in both texts), and
the refinement is used recursively: first over whole contexts (all windows that a sample owns),
which settles copies and long passages, then over single windows, only in buckets where different
contexts remain.

Samples and windows travel as packed arrays between tasks, by bucket, and findings go back to the
documents by a hash of their id. Before anything is sent, a task settles what repeats within its own
batch, and a bucket with many contexts in one batch is dealt out by context; its marker in the
home bucket makes all others there look at single windows, so nothing is lost.

Bytes are compared by their identifiers: samples by 48 bits of their bucket and 64 of their context, so that
contexts of one bucket meet by 64 bits, single windows by 128 bits of two independent hashes.

Defined results: null is the empty text; texts shorter than `length` lose nothing; documents without an
id come after all others; rows that repeat a doc_id don't repeat one another; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .suffixes import Samples, mixed

LENGTH, GRAM = 50, 24
#: Bytes of text that a task handles at once; samples of a bucket cell; bytes of a document cell.
BATCH, CELL_SAMPLES, CELL_BYTES = 2_000_000, 1_500_000, 16_000_000
#: Contexts of one bucket in one batch from which the bucket is dealt out by context.
HOT = 256
#: Bytes of a bucket's identifier that travel.
GRAM_BYTES = 6
LAST = (1 << 63) - 1


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def expand(data: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.decompress(bytes(data))
    sizes = np.frombuffer(raw, np.int64, len(types))
    at = np.cumsum(np.concatenate([[8 * len(types)], sizes]))
    return [np.frombuffer(raw[a:b], t) for a, b, t in zip(at[:-1], at[1:], types)]


def narrow(h: np.ndarray, width: int) -> np.ndarray:
    return h.view(np.uint8).reshape(-1, 8)[:, :width]


def widen(b: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = b.reshape(-1, width)
    return out.view(np.uint64)[:, 0]


def parts(cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell's number and the places that go there, in their order."""
    order = np.argsort(cell, kind="stable")
    c = cell[order]
    edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])) if len(c) else np.zeros(1, int)
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(c[a]), order[a:b]


def heads(doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the same document: ids, row checks and lengths."""
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])) if len(doc) else np.zeros(0, int)
    return doc[new], row[new], np.diff(np.concatenate([new, [len(doc)]])).astype(np.int32)


def findings(doc: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray, open_: np.ndarray) -> bytes:
    """Packed: windows first..first+count-1 of a document are to be removed, or (open) to be looked at one by one."""
    order = np.lexsort((first, row, doc))
    d, r, n = heads(doc[order], row[order])
    return squeeze(d, r, n, np.diff(first[order], prepend=0).astype(np.int32), count[order].astype(np.int32), open_[order].astype(np.uint8))


def read_findings(data: bytes) -> tuple[np.ndarray, ...]:
    d, r, n, first, count, open_ = expand(data, "i8", "u4", "i4", "i4", "i4", "u1")
    return np.repeat(d, n), np.repeat(r, n), np.cumsum(first, dtype=np.int64), count.astype(np.int64), open_.astype(bool)


def _ends(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Marks the first of each run of equal keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def batches_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, held = [], [], 0
    for frame in frames:
        for i, t in zip(frame["doc_id"], frame["text"]):
            ids.append(LAST if pd.isna(i) else int(i))
            texts.append(bytes(t) if t is not None else b"")
            held += len(texts[-1])
            if held > BATCH:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def by_document(doc, row, first, count, open_, buckets: int) -> Iterator[tuple[int, bytes]]:
    for b, at in parts((mixed(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
        yield b, findings(doc[at], row[at], first[at], count[at], open_[at])


def sample(frames: Iterator[pd.DataFrame], cells: int, buckets: int, length: int, q: int) -> Iterator[pd.DataFrame]:
    """Packed samples by bucket cell; what a batch settles by itself goes on to document cells (numbers from `cells` on)."""
    for ids, texts in batches_of(frames):
        s = Samples(texts, length, q)
        if not len(s.doc):
            continue
        ids = np.array(ids, np.int64)
        rows = np.array([zlib.crc32(t) for t in texts], np.uint32)
        doc = ids[s.doc]
        order = np.lexsort((doc, s.context, s.gram))
        new = _ends((s.gram[order], s.context[order]))
        lowest = doc[order][new][np.cumsum(new) - 1]
        settled = np.zeros(len(doc), bool)
        settled[order] = doc[order] > lowest
        out = []
        at = np.flatnonzero(settled)
        if len(at):
            out += [(cells + b, d) for b, d in by_document(doc[at], rows[s.doc[at]], s.first[at], s.count[at], np.zeros(len(at), bool), buckets)]
        at = np.flatnonzero(~settled)
        gram, n_ctx = np.unique(s.gram[at], return_inverse=True, return_counts=True)[1:]
        hot = n_ctx[gram] > HOT
        cell = np.where(hot, s.context[at] % np.uint64(cells), s.gram[at] >> np.uint64(40)) % np.uint64(cells)
        if hot.any():  # one marker for each such bucket at home; it has no windows
            h = np.flatnonzero(hot)
            marks = h[np.unique(gram[h], return_index=True)[1]]
            at = np.concatenate([at, at[marks]])
            cell = np.concatenate([cell, s.gram[at[-len(marks) :]] >> np.uint64(40)]) % np.uint64(cells)
            count = s.count[at].copy()
            count[-len(marks) :] = 0
            hot = np.concatenate([hot, np.ones(len(marks), bool)])
        else:
            count = s.count[at]
        for c, i in parts(cell.astype(np.int64)):
            k = at[i]
            d, r, n = heads(doc[k], rows[s.doc[k]])
            out.append((c, squeeze(d, r, n, np.diff(s.first[k], prepend=0).astype(np.int32), count[i].astype(np.uint8), hot[i].astype(np.uint8), narrow(s.gram[k], GRAM_BYTES), narrow(s.context[k], 8))))
        yield pd.DataFrame(out, columns=["cell", "data"])


def settle(frame: pd.DataFrame, cells: int, buckets: int) -> pd.DataFrame:
    """A bucket cell: samples whose context a smaller document has are settled; the others of shared buckets stay open."""
    cell = int(frame["cell"].iloc[0])
    if cell >= cells:
        return pd.DataFrame({"bucket": cell - cells, "data": list(frame["data"])})
    got = [expand(d, "i8", "u4", "i4", "i4", "u1", "u1", "u1", "u1") for d in frame["data"]]
    doc, row = (np.concatenate([np.repeat(g[k], g[2]) for g in got]) for k in (0, 1))
    first = np.concatenate([np.cumsum(g[3], dtype=np.int64) for g in got])
    count, hot = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (4, 5))
    gram, context = (np.concatenate([widen(g[k], w) for g in got]) for k, w in ((6, GRAM_BYTES), (7, 8)))
    order = np.lexsort((doc, context, gram))
    doc, row, first, count, hot, gram, context = (x[order] for x in (doc, row, first, count, hot, gram, context))
    g_new, c_new = _ends((gram,)), _ends((gram, context))
    g = np.cumsum(g_new) - 1
    lowest = doc[c_new][np.cumsum(c_new) - 1]
    g_at = np.flatnonzero(g_new)
    several = (np.minimum.reduceat(doc, g_at) != np.maximum.reduceat(doc, g_at)) | (np.maximum.reduceat(hot, g_at) > 0)
    mixed_ = np.add.reduceat(c_new.astype(np.int64), g_at) > 1
    gone = (doc > lowest) & (count > 0)
    look = ~gone & (several & (mixed_ | (np.maximum.reduceat(hot, g_at) > 0)))[g] & (count > 0)
    at = np.flatnonzero(gone | look)
    return pd.DataFrame(by_document(doc[at], row[at], first[at], count[at], look[at], buckets), columns=["bucket", "data"])


def text_cells(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Packed texts by document cell."""
    for ids, texts in batches_of(frames):
        ids = np.array(ids, np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        out = []
        for b, at in parts((mixed(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
            out.append((b, zstandard.compress(np.array([len(at)], np.int64).tobytes() + ids[at].tobytes() + sizes[at].tobytes() + b"".join(texts[i] for i in at), 1)))
        yield pd.DataFrame(out, columns=["bucket", "data"])


def read_texts(data: bytes) -> Iterator[tuple[int, bytes]]:
    raw = zstandard.decompress(bytes(data))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    at = 8 + 16 * n
    for i, s in zip(ids.tolist(), sizes.tolist()):
        yield i, raw[at : at + s]
        at += s


def found_by_row(frame: pd.DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, row check): first, count, open of all findings."""
    if not len(frame):
        return {}
    got = [read_findings(d) for d in frame["data"]]
    doc, row, first, count, open_ = (np.concatenate([g[k] for g in got]) for k in range(5))
    order = np.lexsort((row, doc))
    doc, row, first, count, open_ = (x[order] for x in (doc, row, first, count, open_))
    edge = np.concatenate([np.flatnonzero(_ends((doc, row))), [len(doc)]])
    return {(int(doc[a]), int(row[a])): (first[a:b], count[a:b], open_[a:b]) for a, b in zip(edge[:-1], edge[1:])}


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def open_windows(found: pd.DataFrame, texts: pd.DataFrame, cells: int, buckets: int, length: int, q: int) -> pd.DataFrame:
    """Packed single windows of open samples by window cell; repeats within the batch are settled at once."""
    rows = {k: v for k, v in found_by_row(found).items() if v[2].any()}
    out: list[tuple[int, bytes]] = []
    pending: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not pending:
            return
        s = Samples([t for _, _, t in pending], length, q)
        checks = s.checks()
        doc, row, at, key, check = [], [], [], [], []
        for k, (i, r, t) in enumerate(pending):
            first, count, open_ = rows[i, r]
            w = np.unique(spread(first[open_], count[open_]))
            doc.append(np.full(len(w), i, np.int64))
            row.append(np.full(len(w), r, np.uint32))
            at.append(w)
            key.append(s.windows[s.begin[k] + w])
            check.append(checks[s.begin[k] + w])
        doc, row, at, key, check = (np.concatenate(x) for x in (doc, row, at, key, check))
        order = np.lexsort((doc, check, key))
        new = _ends((key[order], check[order]))
        later = np.zeros(len(doc), bool)
        later[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
        j = np.flatnonzero(later)
        if len(j):
            out.extend((cells + b, d) for b, d in by_document(doc[j], row[j], at[j], np.ones(len(j), np.int64), np.zeros(len(j), bool), buckets))
        j = np.flatnonzero(~later)
        for c, i in parts((key[j] % np.uint64(cells)).astype(np.int64)):
            x = j[i]
            d, r, n = heads(doc[x], row[x])
            out.append((c, squeeze(d, r, n, np.diff(at[x], prepend=0).astype(np.int32), key[x], check[x])))
        pending.clear()

    held = 0
    for data in texts["data"]:
        for i, t in read_texts(data):
            r = zlib.crc32(t)
            if (i, r) in rows:
                pending.append((i, r, t))
                held += len(t)
                if held > BATCH:
                    flush()
                    held = 0
    flush()
    return pd.DataFrame(out, columns=["cell", "data"])


def settle_windows(frame: pd.DataFrame, cells: int, buckets: int) -> pd.DataFrame:
    """A window cell: windows that a smaller document has too are settled."""
    cell = int(frame["cell"].iloc[0])
    if cell >= cells:
        return pd.DataFrame({"bucket": cell - cells, "data": list(frame["data"])})
    got = [expand(d, "i8", "u4", "i4", "i4", "u8", "u8") for d in frame["data"]]
    doc, row = (np.concatenate([np.repeat(g[k], g[2]) for g in got]) for k in (0, 1))
    at = np.concatenate([np.cumsum(g[3], dtype=np.int64) for g in got])
    key, check = (np.concatenate([g[k] for g in got]) for k in (4, 5))
    order = np.lexsort((doc, check, key))
    new = _ends((key[order], check[order]))
    later = order[doc[order] > doc[order][new][np.cumsum(new) - 1]]
    return pd.DataFrame(by_document(doc[later], row[later], at[later], np.ones(len(later), np.int64), np.zeros(len(later), bool), buckets), columns=["bucket", "data"])


def removed_spans(first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [a, b) from settled windows."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], first[order] + count[order] + length - 1
    top = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > top[:-1]])
    return a[new], top[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]


def cut_texts(found: pd.DataFrame, texts: pd.DataFrame, length: int, with_text: bool) -> pd.DataFrame:
    rows = found_by_row(found)
    out = []
    for data in texts["data"]:
        for i, t in read_texts(data):
            spans: list[list[int]] = []
            keep = t
            got = rows.get((i, zlib.crc32(t)))
            if got is not None and not got[2].all():
                a, b = removed_spans(got[0][~got[2]], got[1][~got[2]], length)
                spans = np.stack([a, b], axis=1).tolist()
                keep = b"".join(t[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(t)]))
            out.append((None if i == LAST else i, len(t), len(t) - len(keep), len(spans), hashlib.sha256(keep).hexdigest(), [x for s in spans for x in s] if with_text else [], keep if with_text else None))
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text: spans (starts and ends of removed runs, in bytes) and kept (the bytes that stay)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cells = max(32, -(-int(total * 2 / (length - q + 2)) // CELL_SAMPLES))
    buckets = max(32, -(-total // CELL_BYTES))
    sampled = base.mapInPandas(lambda it: sample(it, cells, buckets, length, q), "cell long, data binary")
    found = stored(sampled.groupBy("cell").applyInPandas(lambda f: settle(f, cells, buckets), "bucket long, data binary"))
    texts = base.mapInPandas(lambda it: text_cells(it, buckets), "bucket long, data binary")
    windows = found.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInPandas(lambda f, t: open_windows(f, t, cells, buckets, length, q), "cell long, data binary")
    more = windows.groupBy("cell").applyInPandas(lambda f: settle_windows(f, cells, buckets), "bucket long, data binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"
    return found.unionByName(more).groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInPandas(lambda f, t: cut_texts(f, t, length, with_text), schema)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
