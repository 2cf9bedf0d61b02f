import hashlib
import random

import pytest
from wordloom.llm import suffix_dedup as S


def brute(docs, length):
    rows = sorted(((i, (t or "").encode()) for i, t in docs), key=lambda r: r[0])
    first = {}
    for i, b in rows:
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, b in docs:
        b = (b or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cases():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    line = " ".join(word() for _ in range(18))
    short = line[:60]
    base = " ".join(word() for _ in range(300))
    docs = [(0, None), (1, ""), (2, "a" * 400), (3, "a" * 49), (4, "a" * 50), (5, base), (6, base), (7, base[:700] + "X" + base[701:]), (8, "ab" * 300), (8, "second row " + base[100:400]), (9, "ba" * 40)]
    for i in range(10, 400):
        docs.append((i, " ".join(word() for _ in range(r.randint(5, 40))) + r.choice(["", " " + short + " ", line, base[50:110], base[51:101]]) + " ".join(word() for _ in range(20))))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot", [2, 256])
def test_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT", hot)
    docs = cases()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, bucket string").repartition(4)
    got = sorted(tuple(r) for r in S.repeats_digest(frame).collect())
    assert got == brute(docs, 50)


def test_other_lengths_and_kept_bytes(spark):
    docs = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.remove_repeats(frame, length=20, q=10).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(docs, 20)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in got)


def test_empty_table(spark):
    assert S.repeats_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
