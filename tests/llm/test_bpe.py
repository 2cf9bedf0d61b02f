import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from wordloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "don't WE'LL 'tis", "a" * 3000, "ab" * 500, "  \t lines\r\n\r\n end   ", "naïve Übergröße 東京都 🙂🙂 é \x00\x1c\x85  ", "1234567 3.14 x²", "՘֋ ೜\U0001f9ff"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


def same(encoder, library, texts):
    for t, got in zip(texts, encoder.encode(texts), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_odd_texts_equal_the_library(vocabulary, library):
    same(bpe.Encoder(vocabulary), library, ODD)


def test_random_strings_equal_the_library(vocabulary, library):
    r = random.Random(3)
    alphabets = ["ab ", "etaoin shrdlu ETAOIN\n'", "0123456789.,- ", "àéüß€ñ¿ 漢字かな한글 עברית", "".join(map(chr, range(1, 0x250))), "aA1! \n\t　'sdlmtrve"]
    texts = ["".join(r.choices(r.choice(alphabets), k=r.choice([1, 5, 40, 400]))) for _ in range(1500)]
    encoder = bpe.Encoder(vocabulary)
    for i in range(0, len(texts), 70):
        same(encoder, library, texts[i : i + 70])


def test_every_character_is_cut_as_the_library_cuts(vocabulary, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 4000):
        text = "".join(f"a{c}1{c}!{c} {c}{c}b" for c in every[i : i + 4000])
        assert [len(w) for ws in vocabulary.words(text) for w in ws if w not in vocabulary.added] == [b - a for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_merged_equals_merging_word_by_word(vocabulary):
    """The index over many words against the plain loop: of one word, merge the lowest rank, leftmost first."""
    r = random.Random(5)
    words = ["".join(r.choices("aabcs ingthe", k=r.randint(1, 30))).encode() for _ in range(400)] + [b"\xff\xfe", b"a" * 99]
    want, ranks = [], {(a, b): i for i, (a, b, _) in enumerate(vocabulary.merges.tolist())}
    for w in words:
        s = [int(vocabulary.byte_ids[b]) for b in w]
        while ranked := [(ranks[k], i) for i in range(len(s) - 1) if (k := (s[i], s[i + 1])) in ranks]:
            rank, i = min(ranked)
            s[i : i + 2] = [int(vocabulary.merges[rank, 2])]
        want.append(s)
    tokens, counts = bpe.merged(words, vocabulary)
    assert [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])] == want


def test_long_texts_in_pieces_and_forgetting(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    r = random.Random(7)
    texts = [" ".join("".join(r.choices("abcdef.,1 \n", k=r.randint(1, 9))) for _ in range(300)) + "<|endoftext|>" for _ in range(12)]
    encoder = bpe.Encoder(vocabulary)
    same(encoder, library, texts[:5])
    same(encoder, library, texts[5:])
    same(encoder, library, ["x" * 700 + " y" * 99, ""])


def test_digest(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 200)
    rows = [(i, t, 5) for i, t in enumerate(ODD * 3)] + [(None, "no id", 1), (7, None, 2), (7, "twice", 2), (7, "twice", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = [tuple(x) for x in bpe.bpe_digest(docs, PATH).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bpe.bpe_digest(docs.where("doc_id = -1"), PATH).count() == 0
    v = bpe.Vocabulary.read(PATH)
    two = bpe.decode(bpe.encode(docs, v, keep=("doc_id", "text")), v).collect()
    assert len(two) == len(rows) and all(r.decoded == (r.text or "") for r in two)


def test_decode_of_broken_bytes(spark, vocabulary, library):
    ids = [[int(vocabulary.byte_ids[b]) for b in bs] for bs in (b"\xe6\x9d", b"a\xff\xfeb", b"\xf0\x9f\x99", b"")]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)], "n int, ids binary")
    assert {r.n: r.decoded for r in bpe.decode(df, vocabulary).collect()} == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
