"""Byte-level BPE encoding and decoding by an index of pair occurrences.

Texts are cut at added tokens and then into words by the vocabulary's pattern. The words of a batch
that its task has not met yet stand behind each other as one chain of byte symbols. An index maps
each adjacent pair that can merge to all its positions. Active ranks are applied in ascending order:
all places of the lowest rank are merged from left to right, and the lists of the pairs that a merge
makes get its position. A place whose symbols have changed meanwhile is passed over. As a token is
made by one merge and used only by later ones, this equals merging each word by itself.

Texts come in batches of a bounded number of bytes, and a very long one is cut where a word must end, so
memory grows with the longest text alone. Nothing is shuffled: a hot key or a group of copies costs
what its bytes cost.

Defined results: a null text is empty and has no tokens; an added token's string inside a text is that
token; columns that are named to be kept pass unchanged (also ids that are null or repeated), others are
not read; an empty table gives an empty result. Bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are encoded together, and characters after which a text is cut at the next certain word end.
BATCH_BYTES, PIECE = 8 << 20, 1 << 20
#: Words, and their tokens, that a task remembers.
REMEMBERED, REMEMBERED_TOKENS = 1 << 18, 1 << 22
#: The classes of characters, as `re` has them, that byte-level vocabularies cut text by.
CLASSES = {"letter": r"[^\W\d_]", "number": r"\d", "other": r"(?:[^\s\w]|_)", "space": r"\s"}
#: The endings that are words of their own, and the added tokens' flags that change a match.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
FLAGS = ("single_word", "lstrip", "rstrip")
WORDS = "|".join([ENDINGS, *(f" ?{CLASSES[c]}+" for c in ("letter", "number", "other")), r"\s+(?!\S)", r"\s+"])
#: A word certainly ends before a space between a visible character and a letter.
CERTAIN_END = re.compile(r"(?<=[a-z0-9.,]) (?=[a-z])")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is visible Latin-1, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


@lru_cache(maxsize=1)
def odd_characters() -> dict[int, str]:
    """Code points that the library classes otherwise than CLASSES do, each with a character of the class that it gives them.

    Found by asking the library for the cuts in runs of one class.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cuts = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    standing = {"letter": "a", "number": "1", "other": "!", "space": "\t"}

    def of(c: str) -> str:
        return next((k for k in ("letter", "number", "other") if len(cuts(standing[k] + c)) == 1), "space")

    odd = {}
    for name, pattern in CLASSES.items():
        run = "".join(re.findall(pattern, every))
        for _, (a, b) in cuts(run) if name != "space" else [(0, (i, i + 1)) for i in range(len(run))]:
            if (got := of(run[a])) != name:
                odd |= {ord(c): standing[got] for c in run[a:b]}
    return odd


@dataclass
class Vocabulary:
    """What encoding needs of a vocabulary: the id of each byte, merges by rank, bytes of each id, added tokens."""

    byte_ids: np.ndarray
    merges: np.ndarray  # rank x (left, right, made)
    tokens: list[bytes]
    added: dict[str, int]
    odd: dict[int, str] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """The vocabulary in a tokenizers file; raises ValueError if it is of another kind than byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        unusual = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or unusual or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t.get(k) for t in spec["added_tokens"] for k in FLAGS):
            raise ValueError(f"{path} has added tokens that take up their surroundings")
        ids, symbols = model["vocab"], byte_symbols()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        made = np.full(max(ids.values()) + 1, -1)
        made[merges[:, 2]] = np.arange(len(merges))
        if len({*merges[:, 2].tolist()}) < len(merges) or (made[merges[:, :2]] >= np.arange(len(merges))[:, None]).any():
            raise ValueError(f"{path} has a token that two merges make, or a merge before its parts")
        of = {c: bytes([b]) for b, c in enumerate(symbols)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for name, i in [*ids.items(), *added.items()]:
            tokens[i] = b"".join(of[c] for c in name) if all(c in of for c in name) else name.encode()
        return cls(np.array([ids[c] for c in symbols], np.int64), merges, tokens, added, odd_characters())

    @cached_property
    def cutter(self) -> re.Pattern:
        return re.compile(WORDS)

    @cached_property
    def odd_one(self) -> re.Pattern:
        """Finds odd characters up to U+FFFF, and all above; `re` has a bit for each of the former."""
        low = np.array(sorted(c for c in self.odd if c < 0x10000), np.int64)
        runs = np.split(low, np.flatnonzero(np.diff(low) > 1) + 1) if len(low) else []
        return re.compile("[" + "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs) + "]|[\U00010000-\U0010FFFF]")

    @cached_property
    def special(self) -> re.Pattern | None:
        return re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def plain_words(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if text.isascii() or all(ord(c) not in self.odd for c in {*self.odd_one.findall(text)}):
            return self.cutter.findall(text)
        return [text[m.start() : m.end()] for m in self.cutter.finditer(text.translate(self.odd))]

    def words(self, text: str) -> Iterator[list]:
        """Lists of the text's words in order; an added token is its id."""
        at = 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            end = m.start() if m else len(text)
            while at < end:
                stop = CERTAIN_END.search(text, at + PIECE, end) if end - at > PIECE else None
                upto = stop.start() if stop else end
                yield self.plain_words(text[at:upto])
                at = upto
            if m:
                yield [self.added[m[0]]]
                at = m.end()


def merged(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words behind each other, and how many each word has."""
    n = np.array([len(w) for w in words], np.int64)
    # One symbol of no pair stands before each word and at the end, so that no merge crosses words.
    wall = len(vocabulary.tokens)
    starts = np.cumsum(n + 1) - n
    chain = np.full(int(n.sum()) + len(n) + 1, wall, np.int64)
    inside = np.ones(len(chain), bool)
    inside[starts - 1] = inside[-1] = False
    chain[inside] = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    merges = vocabulary.merges
    keys = merges[:, 0] << 32 | merges[:, 1]
    order = np.argsort(keys)
    pairs = chain[:-1] << 32 | chain[1:]
    found = np.minimum(np.searchsorted(keys[order], pairs), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
    at = np.flatnonzero(keys[order][found] == pairs) if len(keys) else found
    rank = order[found[at]] if len(keys) else found
    by_rank = np.argsort(rank, kind="stable")
    active, first = np.unique(rank[by_rank], return_index=True)
    at, first = at[by_rank], np.append(first, len(at)).tolist()
    begun = {r: at[i:j] for r, i, j in zip(active.tolist(), first, first[1:])}  # positions at the start, ascending
    later: dict[int, list] = {}  # those that merges add
    todo = active.tolist()  # ascending, so a heap
    sym, after, before = chain, np.arange(1, len(chain) + 1), np.arange(-1, len(chain) - 1)
    keys, table = keys[order], merges.tolist()
    while todo:
        r = heapq.heappop(todo)
        a, b, made = table[r]
        p = begun.get(r)
        if r in later:
            more = np.concatenate(later.pop(r))
            p = np.unique(more if p is None else np.concatenate([p, more]))
        q = after[p]
        alive = (sym[p] == a) & (sym[q] == b)
        p, q = p[alive], q[alive]
        if a == b and len(p) > 1:  # of overlapping places every second one, from the left
            i = np.arange(len(p))
            joined = np.append(False, p[1:] == q[:-1])
            alive = (i - np.maximum.accumulate(np.where(joined, 0, i))) % 2 == 0
            p, q = p[alive], q[alive]
        if not len(p):
            continue
        right = after[q]
        sym[p], sym[q] = made, -1
        after[p], before[right] = right, p
        left = before[p]
        places, pairs = np.concatenate([left, p]), np.concatenate([sym[left] << 32 | made, made << 32 | sym[right]])
        found = keys.searchsorted(pairs)
        real = keys.take(found, mode="clip") == pairs
        if not real.any():
            continue
        new, places = order[found[real]], places[real]
        if len(new) > 1:
            by_new = new.argsort(kind="stable")
            new, places = new[by_new], places[by_new]
        cuts = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1).tolist(), len(new)]
        for i, j in zip(cuts, cuts[1:]):
            n_r = int(new[i])
            if n_r in later:
                later[n_r].append(places[i:j])
            else:
                later[n_r] = [places[i:j]]
                if n_r not in begun:
                    heapq.heappush(todo, n_r)
    real = (sym >= 0) & (sym != wall)
    counts = np.diff(np.append(np.cumsum(real)[starts - 1], real.sum())) if len(n) else n
    return sym[real], counts


class Numbers(dict):
    """Words by number; an unknown one gets the next, and waits."""

    def __init__(self, known: list) -> None:
        super().__init__(zip(known, range(len(known))))
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.waiting.append(word)
        return n


class Encoder:
    """A task's encoder; it remembers the tokens of words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        special = sorted(self.vocabulary.added.values())
        self.known, self.flat, self.count = Numbers(special), np.array(special, np.int64), np.ones(len(special), np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > REMEMBERED or len(self.flat) > REMEMBERED_TOKENS:
            self.forget()
        numbers, per_text = [np.zeros(0, np.int64)], []
        for text in texts:
            n = 0
            for words in self.vocabulary.words(text):
                numbers.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
                n += len(words)
            per_text.append(n)
        if self.known.waiting:
            tokens, counts = merged([w.encode() for w in self.known.waiting], self.vocabulary)
            self.flat, self.count = np.append(self.flat, tokens), np.append(self.count, counts)
            self.known.waiting.clear()
        at = np.concatenate(numbers)
        n, start = self.count[at], (np.cumsum(self.count) - self.count)[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(start - (ends - n), n) + np.arange(int(n.sum()))]
        return np.split(ids, np.append(0, ends)[np.cumsum(per_text)][:-1]) if texts else []


def batches(column: pa.Array, limit: int | None = None) -> Iterator[slice]:
    """Slices of a column of texts or bytes of about `limit` bytes (BATCH_BYTES if none is given), one value at least."""
    begin = held = 0
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + n > (limit or BATCH_BYTES):
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def part_of(column: pa.Array, part: slice) -> list:
    return column.slice(part.start, part.stop - part.start).to_pylist()


def text_of(ids: np.ndarray, tokens: list[bytes]) -> str:
    """The text of token ids; ids without a token have no bytes."""
    n = len(tokens)
    return b"".join([tokens[i] if i < n else b"" for i in ids.tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: tuple = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The kept columns, n_tokens, and ids: the text's token ids as little-endian unsigned 32-bit integers, behind each other; with `decoded` also the text that they decode to, without a second pass."""
    kept = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    names = [*keep, "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for table in tables:
            column = table.column(len(keep))
            for part in batches(column):
                ids = encoder.encode(part_of(column, part))
                made = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    made.append(pa.array([text_of(x, vocabulary.tokens) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*[table.column(i)[part.start : part.stop] for i in range(len(keep))], *made], names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}n_tokens bigint, ids binary{', decoded string' if decoded else ''}")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the text of its ids (as encode() gives them)."""
    names, at, tokens = encoded.columns, encoded.columns.index(ids_col), vocabulary.tokens

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            column = table.column(at)
            for part in batches(column):
                texts = [text_of(np.frombuffer(x or b"", "<u4"), tokens) for x in part_of(column, part)]
                yield pa.RecordBatch.from_arrays([*[table.column(i)[part.start : part.stop] for i in range(len(names))], pa.array(texts, pa.string())], [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: counts, and the hashes of the ids and of the text that they decode to."""
    out = encode(docs, Vocabulary.read(path), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
