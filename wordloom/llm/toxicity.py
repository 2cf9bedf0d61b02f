"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled rows: at most `per_class` rows and `sample_bytes` of
text of each label, in the order of a hash of the id. The index holds every word of the examples.
Words are known by their 64-bit hashes, so that no list of words is held anywhere.
A word weighs (1 + log tf) * idf * (1 + its z-score where it leans to label 1); document frequencies
count all documents, exactly for the examples' words and in hash buckets for all others, which can
match no example but count in a text's length. A document's k nearest examples are found exactly:
the lists of the most frequent words are read whole, as rows of a matrix; for all others, blocks of like
examples are taken by their bounds (sums of block maxima) until no bound reaches the k-th best cosine. Votes weighted by cosine, with each example standing for its share of its label's
rows, are calibrated by isotonic regression over the examples' leave-one-out votes.

Defined results: null and empty texts have no words, no neighbours, and the score that the prior
alone gets; a doc_id labelled twice takes its larger label, one with several texts its smallest;
null labels are left out; equal cosines go to the smaller example; without examples of both labels
every score is the share of label 1 (0.5 without labels); repeated rows are scored each; an empty
table gives an empty result; no column but id, text and the labels' toxic is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The sample's bounds; they bound the index, the model and what the driver reads.
PER_CLASS, SAMPLE_BYTES = 2000, 16_000_000
NEIGHBOURS, PRIOR_WEIGHT, BLOCK, SEED_BLOCKS = 20, 0.2, 64, 6
#: A word is frequent if more than one in so many examples has it; at most so many words are. Documents multiplied at once.
FREQUENT, MATRIX_ROWS, GROUP = 16, 512, 64
#: Hash buckets of the document frequencies of words that no example has.
BUCKETS = 1 << 18
#: Words whose places a task remembers.
REMEMBERED = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
NONE = np.zeros(0)


def word_counts(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


def hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


class Places:
    """Places of words: the number of a term, or, for all other words, len(terms) + the bucket."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms, self.known = terms, {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if new := [w for w in words if w not in known]:
            if len(known) > REMEMBERED:
                known.clear()
                new = words
            known.update(zip(new, self._find(hashes(new)).tolist()))
        return np.array([known[w] for w in words], np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        n = len(self.terms)
        at = np.minimum(np.searchsorted(self.terms, h), max(0, n - 1))
        return np.where(self.terms[at] == h, at, n + (h % np.uint64(BUCKETS)).astype(np.int64)) if n else (h % np.uint64(BUCKETS)).astype(np.int64)


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] of them), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@dataclass
class Model:
    """The index (cells of one term and one block, with their postings and maxima) and what turns votes into scores."""

    terms: np.ndarray  # hashes, ascending
    weight: np.ndarray  # of each term, then of each bucket
    prior: float
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    stands: np.ndarray = field(default_factory=lambda: np.zeros(0))  # rows that an example stands for
    blocks: int = 0
    block_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    row_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each term in the matrix, or -1
    often: tuple[np.ndarray, np.ndarray, np.ndarray] = (NONE, NONE, NONE)  # matrix row, example and value of its postings
    term_cells: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    cell_block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cell_start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    peaks: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    votes: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    scores: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    @cached_property
    def matrix(self) -> np.ndarray:
        """Frequent terms x examples; made where it is used."""
        out = np.zeros((int(self.row_of.max(initial=-1)) + 1, len(self.ids)))
        out[self.often[0], self.often[1]] = self.often[2]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("matrix", "places")}

    @cached_property
    def places(self) -> Places:
        return Places(self.terms)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms in the index, and their shares of its unit vector over all of its words."""
        at, w = self.unit(self.places.of(list(counts)), np.fromiter(counts.values(), float, len(counts)))
        known = at < len(self.terms)
        return at[known], w[known]

    def unit(self, places: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places and their shares of the unit vector."""
        w = (1 + np.log(tf)) * self.weight[places]
        size = float(w @ w)
        return places, (w / np.sqrt(size) if size > 0 else w)

    def _cosines(self, cells: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cosines of all examples as far as those cells hold them; w: the query's weight at each cell."""
        begin = self.cell_start[cells]
        n = self.cell_start[cells + 1] - begin
        at = ragged(begin, n)
        return np.bincount(self.rows[at], weights=np.repeat(w, n) * self.values[at], minlength=len(self.ids))

    def nearest(self, terms: np.ndarray, w: np.ndarray, cos: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k best examples and cosines, exactly; cos: what the frequent terms give; `without` leaves one example out.

        The blocks of highest bounds give a floor, the k-th best cosine as far as it is read; only blocks whose bound reaches it are read too.
        """
        begin = self.term_cells[terms]
        n = self.term_cells[terms + 1] - begin
        cells = ragged(begin, n)
        w = np.repeat(w, n)
        block = self.cell_block[cells]
        bound = np.maximum.reduceat(cos, self.block_at) + np.bincount(block, weights=w * self.peaks[cells], minlength=self.blocks)
        chosen = np.zeros(self.blocks, bool)
        chosen[np.argsort(-bound, kind="stable")[:SEED_BLOCKS]] = True
        now = chosen[block]
        cos = cos + self._cosines(cells[now], w[now])

        def floor() -> float:
            if without >= 0:
                cos[without] = 0
            return float(np.partition(cos, -k)[-k]) if len(cos) >= k else 0.0

        least = floor()
        more = (~chosen & (bound > 0) & (bound >= least - 1e-9))[block]
        if more.any():
            cos += self._cosines(cells[more], w[more])
            least = floor()
        who = np.flatnonzero((cos > 1e-12) & (cos >= least - 1e-9))
        best = np.lexsort((self.ids[who], -np.round(cos[who], 9)))[:k]
        return who[best], cos[who[best]]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each vector; own: the example that each one is, to be left out."""
        for at in range(0, len(vectors), GROUP):
            some = vectors[at : at + GROUP]
            frequent = np.zeros((len(some), len(self.matrix)))
            rare = []
            for i, (terms, w) in enumerate(some):
                row = self.row_of[terms]
                often = row >= 0
                frequent[i, row[often]] = w[often]
                rare.append((terms[~often], w[~often]))
            for i, (cos, (terms, w)) in enumerate(zip(frequent @ self.matrix, rare)):
                yield self.nearest(terms, w, cos, without=-1 if own is None else int(own[at + i]))

    def vote(self, who: np.ndarray, cos: np.ndarray) -> float:
        w = cos * self.stands[who]
        return float((w @ self.labels[who] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def scores_of(self, texts: list[Counter]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Score of each text, and the examples and cosines that it rests on."""
        if not len(self.ids):
            yield from ((self.prior, np.zeros(0, np.int64), NONE) for _ in texts)
            return
        for who, cos in self.nearest_of([self.vector(c) for c in texts]):
            yield float(np.clip(np.interp(self.vote(who, cos), self.votes, self.scores), 0.0, 1.0)), self.ids[who], np.minimum(cos, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted increasing step fit of y on x, as its blocks' mean x and mean y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def idf(df: np.ndarray, documents: int) -> np.ndarray:
    return np.log((documents + 1) / (np.minimum(df, documents) + 1)) + 1e-6


def lean(t: np.ndarray, r: np.ndarray, labels: np.ndarray, terms: int) -> np.ndarray:
    """1 plus the z-score of each term's log-odds for label 1, where positive; t and r: the term and example of each posting."""
    a, b = (np.bincount(t, weights=labels[r] == s, minlength=terms) + 0.5 for s in (1, 0))
    na, nb = (labels == 1).sum() + 1.0, (labels == 0).sum() + 1.0
    return 1 + np.maximum(0.0, (np.log(a / na) - np.log(b / nb)) / np.sqrt(1 / a + 1 / b))


def _clustered(t: np.ndarray, r: np.ndarray, v: np.ndarray, n: int, terms: int) -> np.ndarray:
    """An order of the examples in which like ones stand together: by the nearest of n / BLOCK leaders. Postings go by example."""
    begin = np.searchsorted(r, np.arange(n + 1))
    best, which = np.full(n, -1.0), np.zeros(n, np.int64)
    row = np.zeros(terms)
    for k, leader in enumerate(range(0, n, BLOCK)):
        mine = slice(begin[leader], begin[leader + 1])
        row[t[mine]] = v[mine]
        cos = np.bincount(r, weights=v * row[t], minlength=n)
        which[cos > best], best = k, np.maximum(cos, best)
        row[t[mine]] = 0
    return np.lexsort((np.arange(n), -best, which))


def build(terms: np.ndarray, t: np.ndarray, r: np.ndarray, tf: np.ndarray, ids: list[int], labels: list[int], df: np.ndarray, documents: int, sizes: dict[int, int]) -> Model:
    """The model of the examples' postings (term, example, count; by example); df: of each term, then of each bucket; sizes: all labelled rows by label."""
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    y = np.array(labels, float)
    m = Model(terms, idf(df, documents), prior)
    if not len(y) or y.min() == y.max():
        return m
    n = len(y)
    m.weight[: len(terms)] *= lean(t, r, y, len(terms))
    begin = np.searchsorted(r, np.arange(n + 1))
    unit = [m.unit(t[a:b], tf[a:b].astype(float)) for a, b in zip(begin[:-1], begin[1:])]
    v = np.concatenate([u[1] for u in unit])
    order = _clustered(t, r, v, n, len(terms))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    m.ids, m.labels = np.array(ids, np.int64)[order], y[order]
    m.stands = np.array([sizes[int(l)] / (y == l).sum() for l in m.labels])
    m.blocks = -(-n // BLOCK)
    r = place[r]
    m.block_at = np.arange(0, n, BLOCK)
    held = np.bincount(t, minlength=len(terms))
    often = np.argsort(-held, kind="stable")[:MATRIX_ROWS]
    often = often[held[often] * FREQUENT > n]
    m.row_of = np.full(len(terms), -1, np.int16)
    m.row_of[often] = np.arange(len(often))
    mine = m.row_of[t] >= 0
    m.often = m.row_of[t[mine]].astype(np.int16), r[mine].astype(np.int32), v[mine]
    t, r, v = t[~mine], r[~mine], v[~mine]
    by = np.lexsort((r, t))
    t, m.rows, m.values = t[by], r[by].astype(np.int32), v[by]
    cell = t * m.blocks + m.rows // BLOCK
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    m.cell_start = np.concatenate([first, [len(cell)]]).astype(np.int32)
    m.cell_block = (cell[first] % m.blocks).astype(np.int32)
    m.peaks = np.maximum.reduceat(m.values, first) if len(cell) else NONE
    m.term_cells = np.searchsorted(cell[first] // m.blocks, np.arange(len(terms) + 1)).astype(np.int32)
    del t, r, v, by, cell, first, mine
    votes = np.array([m.vote(*x) for x in m.nearest_of([unit[i] for i in order], np.arange(n))])
    m.votes, m.scores = isotonic(votes, m.labels, m.stands)
    return m


def frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Document frequencies of the terms and then of the other words' buckets, and the number of documents.

    A task adds up its documents before it sends anything; at most len(terms) + BUCKETS + 1 numbers come back.
    """
    n = len(terms) + BUCKETS
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the sample

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, places = np.zeros(n + 1, np.int64), Places(shared.value)
        for frame in frames:
            seen: Counter = Counter()
            for text in frame["text"]:
                seen.update(set(LETTERS.findall((text or "").lower())))
            np.add.at(held, places.of(list(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
            held[n] += len(frame)
        some = np.flatnonzero(held)
        yield pd.DataFrame({"at": some, "n": held[some]})

    out = np.zeros(n + 1)
    got = docs.select("text").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out[:n], int(out[n])


def postings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes and counts of each example's words."""
    for frame in frames:
        counts = [word_counts(t) for t in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "words": [hashes(list(c)).tobytes() for c in counts], "counts": [np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in counts]})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model; docs has doc_id and text, labels doc_id and toxic."""
    spark = docs.sparkSession
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = cut(marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    first = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    picked = cut(first(1).union(first(0)))  # the documented sample
    texts = cut(docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")))
    # Within the sample's bytes, in the order of the hash; a text beyond them is no example.
    chosen, held = [], {0: 0, 1: 0}
    for r in texts.select("doc_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held[r["y"]] + r["size"] <= sample_bytes:
            held[r["y"]] += r["size"]
            chosen.append((r["doc_id"],))
    if not chosen:
        return build(np.zeros(0, np.uint64), NONE, NONE, NONE, [], [], np.zeros(BUCKETS), 0, sizes)
    rows = texts.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")
    got = rows.select("doc_id", "y", "text").mapInPandas(postings, "doc_id long, y int, words binary, counts binary").orderBy("doc_id").toArrow()
    words, counts = got.column("words").to_pylist(), got.column("counts").to_pylist()
    terms, t = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)
    r = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) // 8 for w in words])
    tf = np.frombuffer(b"".join(counts), np.int32)
    ids, ys = got.column("doc_id").to_pylist(), got.column("y").to_pylist()
    del got, words, counts
    df, documents = frequencies(docs, terms)
    return build(terms, t.astype(np.int32), r, tf, ids, ys, df, documents, sizes)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text_key, score and the evidence (example ids and cosines) of every row."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(picked, labels, per_class, sample_bytes))  # bounded by the sample

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            for at in range(0, len(frame), 2048):
                part = frame.iloc[at : at + 2048]
                out = list(m.scores_of([word_counts(t) for t in part["text"]]))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "text_key": part["text_key"].array, "score": [s for s, _, _ in out], "examples": [w for _, w, _ in out], "cosines": [c for _, _, c in out]})

    # Ids travel as text: a long column with nulls would reach pandas as floating point.
    scored = picked.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    scored = scored.mapInPandas(run, "doc_id string, text_key long, score double, examples array<long>, cosines array<double>")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def without_toxic(docs: DataFrame, labels: DataFrame, reject: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text scores below `reject`, with all their columns; scored where they are read, so nothing is shuffled."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(picked, labels))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                yield part.filter(pa.array([s < reject for s, _, _ in m.scores_of([word_counts(t) for t in part.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training(labels: DataFrame) -> DataFrame:
    """The labelled rows that may be learnt from."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = toxicity(docs, training(labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
