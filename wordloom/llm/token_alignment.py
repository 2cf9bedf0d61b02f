"""Alignment of two tokenizations of the same text by elementary intervals of their byte offsets.

The ends of the tokens of A and of B are merged into one ascending array. Each interval between two
neighbouring ends lies in one token of A and one of B, found by binary search; so each interval is one
overlap, and no pair of occurrences has two. Ends that both sides have close groups: the smallest runs of
tokens of A and of B with the same bytes.

Corpus counts of id pairs need two passes. Texts are taken in bundles of bounded bytes, encoded once and
stored with the bundle's distinct pairs; the pairs are summed up over the bundles (a frequent pair is one
row for each bundle), each bundle gets the counts of its own pairs back and adds them up by document. So no
table of all pairs is held anywhere; only the highest count of each A id, a table no longer than A's
vocabulary, is broadcast.

Defined results: a text that is null, empty, or whose tokens' joined bytes differ from space and text (say,
because B's normalization changes it) has no tokens: counts of zero and an empty string instead of a hash; rows
with null or repeated ids are documents of their own; other columns are not read; an empty table gives
an empty result. Memory grows with the longest text alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary, batches, part_of
from .common import stored

#: Bytes of text in a bundle.
BUNDLE = 4 << 20
SPACE_MARK = "▁"


@dataclass
class Sides:
    """The two tokenizers: A as a vocabulary for our own encoder, B as the content of its file, opened where it is used."""

    a: Vocabulary
    b_file: bytes

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Sides:
        with open(b_path, "rb") as b:
            return cls(replace(Vocabulary.read(a_path), added={}), b.read())  # special tokens' strings are plain text

    def __getstate__(self) -> dict:
        return {"a": self.a, "b_file": self.b_file}

    @cached_property
    def b(self):  # noqa: ANN201
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.b_file)

    @property
    def a_bytes(self) -> list[bytes]:
        """Bytes of each A id."""
        return self.a.tokens

    @cached_property
    def b_bytes(self) -> list[bytes]:
        """Bytes of each B id."""
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE_MARK, " ").encode() for p, byte in pieces]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str], encoder: Encoder) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A and B ids of each text; none if B's bytes are not space and text (A's always are: each of its tokens is the bytes that it was merged from)."""
        none = np.zeros(0, np.int64)
        a_ids = encoder.encode([f" {t}" if t else "" for t in texts])
        b_ids = self.b.encode(texts, num_threads=1)
        for i, (text, b) in enumerate(zip(texts, b_ids)):
            fits = text and b"".join(map(self.b_bytes.__getitem__, b)) == f" {text}".encode()
            a_ids[i], b_ids[i] = (a_ids[i], np.array(b, np.int64)) if fits else (none, none)
        return a_ids, b_ids


@dataclass
class Alignment:
    """Overlaps, as places of tokens in A and B, and the group of each token."""

    a_at: np.ndarray
    b_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    groups: int

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of an A and a B token of one group, overlapping or not, as places."""
        na, nb = (np.bincount(g, minlength=self.groups) for g in (self.a_group, self.b_group))
        per = nb[self.a_group]  # each A token meets all B tokens of its group
        first = (np.cumsum(nb) - nb)[self.a_group]
        return np.repeat(np.arange(int(na.sum())), per), np.repeat(first - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
    """Two cuts of one byte string, by the lengths of their pieces (none is empty)."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    ends = np.union1d(a_ends, b_ends)
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return Alignment(np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends), len(shared))


class GroupText:
    """Writes groups as `a1,a2|b1;a3|b2,b3;`."""

    def __init__(self, n_a: int, n_b: int) -> None:
        written = lambda n, marks: np.array([f"{i}{mark}".encode() for mark in marks for i in range(n)], object)
        self.a, self.b = written(n_a, ",|"), written(n_b, ",;")

    def pieces(self, a: np.ndarray, b: np.ndarray, al: Alignment) -> list[bytes]:
        """The text of each token with the mark after it, in order."""
        out = np.empty(len(a) + len(b), object)
        for ids, own, other, shift, table in ((a, al.a_group, al.b_group, 0, self.a), (b, al.b_group, al.a_group, 1, self.b)):
            # Before a token: its own side's earlier ones, and the other side's of earlier groups (for B, of its own group too).
            held = np.append(0, np.cumsum(np.bincount(other, minlength=al.groups)))
            ends = np.append(own[1:] != own[:-1], True)[: len(own)]
            out[np.arange(len(ids)) + held[own + shift]] = table[ids + ends * (len(table) // 2)]
        return out.tolist()


BUNDLES = "bundle string, {keep}n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, n_pairs array<bigint>, pair_at binary, times binary, pairs array<struct<a:int,b:int,docs:bigint>>"


def bundles(docs: DataFrame, sides: Sides, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """One row for each bundle of documents.

    Arrays with an entry for each document: the kept columns, numbers of tokens, groups and links, the hash of its
    groups, and how many entries it has in pair_at and times. pairs: the bundle's distinct id pairs, each with the number of
    its documents that have it; pair_at and times (little-endian unsigned 32-bit integers): for each document its distinct pairs' places
    in pairs, and how often it has them.
    """
    kept = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    types = {f.name: f.dataType for f in kept.schema.fields[:-1]}
    schema = BUNDLES.format(keep="".join(f"`{n}` array<{t.simpleString()}>, " for n, t in types.items()))
    pair_type = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])

    def bundle(texts: list[str], encoder: Encoder, group_text: GroupText) -> list:
        """What a bundle's row has after the kept columns. All its documents are aligned at once: they end where both sides end."""
        a_ids, b_ids = sides.encode(texts, encoder)
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        al = align(sides.lengths[0][a], sides.lengths[1][b])
        a_upto, b_upto = (np.cumsum([len(x) for x in ids]) for ids in (a_ids, b_ids))
        groups_upto = np.append(0, al.a_group + 1)[a_upto]
        links_upto = np.append(0, np.searchsorted(al.a_at, a_upto))
        each = lambda upto: np.diff(upto, prepend=0)
        pieces = group_text.pieces(a, b, al)
        bounds = np.append(0, a_upto + b_upto).tolist()
        sha = [hashlib.sha256(b"".join(pieces[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:])]
        width = len(sides.lengths[1])
        keys = a[al.a_at] * width + b[al.b_at]
        own = [np.unique(keys[i:j], return_counts=True) for i, j in zip(links_upto[:-1].tolist(), links_upto[1:].tolist())]
        pairs, at, held = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True, return_counts=True)
        numbers = [each(a_upto), each(b_upto), each(groups_upto), np.diff(links_upto)]
        pair_rows = pa.StructArray.from_arrays([pa.array(pairs // width, pa.int32()), pa.array(pairs % width, pa.int32()), pa.array(held, pa.int64())], fields=list(pair_type))
        packed = lambda x: pa.array([x.astype("<u4").tobytes()], pa.binary())
        return [
            *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in numbers], pa.array([sha], pa.list_(pa.string())), pa.array([[len(k) for k, _ in own]], pa.list_(pa.int64())),
            packed(at), packed(np.concatenate([n for _, n in own])), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pair_rows),
        ]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, group_text = Encoder(sides.a), GroupText(len(sides.a_bytes), len(sides.b_bytes))
        for table in tables:
            column = table.column(len(keep))
            for part in batches(column, BUNDLE):
                given = [pa.array([table.column(i)[part.start : part.stop].to_pylist()], pa.list_(table.schema.field(i).type)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *given, *bundle(part_of(column, part), encoder, group_text)], ["bundle", *keep, "n_a", "n_b", "n_groups", "n_links", "sha", "n_pairs", "pair_at", "times", "pairs"])

    return kept.mapInArrow(run, schema)


def pair_counts(bundled: DataFrame) -> DataFrame:
    """a, b, docs, best: how many documents have the id pair linked, and whether no pair of its A id has more."""
    pairs = bundled.select(F.explode("pairs").alias("p")).select("p.*").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    pairs = stored(pairs)
    highest = pairs.groupBy("a").agg(F.max("docs").alias("highest"))
    return pairs.join(F.broadcast(highest), "a").select("a", "b", "docs", (F.col("docs") == F.col("highest")).alias("best"))  # a row for each A id at most


def aligned(docs: DataFrame, sides: Sides, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The kept columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    bundled = stored(bundles(docs, sides, text_col, keep))
    own = bundled.select("bundle", F.posexplode("pairs").alias("at", "p")).select("bundle", "at", "p.a", "p.b")
    scored = own.join(pair_counts(bundled), ["a", "b"]).select(F.col("bundle").alias("of_bundle"), "at", "docs", "best")
    types = {f.name: f.dataType.elementType for f in bundled.select(*keep).schema.fields}
    names = [*keep, "n_a", "n_b", "n_groups", "n_links", "sha", "n_pairs"]

    def add_up(head: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if head.empty:
            return pd.DataFrame(columns=[*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        row = head.iloc[0]
        docs_of, best_of = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        docs_of[pairs["at"]], best_of[pairs["at"]] = pairs["docs"], pairs["best"]
        at, times = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("pair_at", "times"))
        out = pd.DataFrame({c: pd.Series(list(row[c]), dtype=object if c in (*keep, "sha") else "int64") for c in names})
        ends = np.cumsum(out["n_pairs"].to_numpy())
        for name, of in (("n_best", best_of), ("count_sum", docs_of)):
            upto = np.append(0, np.cumsum(of[at] * times))
            out[name] = upto[ends] - upto[ends - out["n_pairs"].to_numpy()]
        return out.rename(columns={"sha": "groups_sha256"}).drop(columns="n_pairs")

    schema = "".join(f"`{n}` {t.simpleString()}, " for n, t in types.items()) + "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    heads = bundled.drop("pairs")
    return heads.groupBy("bundle").cogroup(scored.groupBy("of_bundle")).applyInPandas(add_up, schema)


def alignment_digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The contract's columns."""
    return aligned(docs, Sides.read(a_path, b_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
