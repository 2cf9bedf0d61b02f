import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from wordloom.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return T.Sides.read(A, B)


def spans(lengths):
    ends = np.cumsum(lengths)
    return list(zip((ends - lengths).tolist(), ends.tolist()))


def brute_overlaps(a, b):
    return [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if s < f and t < e]


def brute_groups(a, b):
    shared = sorted({e for _, e in spans(a)} & {e for _, e in spans(b)})
    return [([i for i, (_, e) in enumerate(spans(a)) if lo < e <= hi], [j for j, (_, e) in enumerate(spans(b)) if lo < e <= hi]) for lo, hi in zip([0, *shared], shared)]


def random_cut(r, n):
    ends = sorted(r.sample(range(1, n), r.randint(0, n - 1))) + [n]
    return np.diff([0, *ends])


@pytest.mark.parametrize("seed", range(60))
def test_intervals_and_groups_equal_all_pairs(seed):
    r = random.Random(seed)
    n = r.randint(1, 40)
    a, b = random_cut(r, n), random_cut(r, n)
    al = T.align(a, b)
    assert list(zip(al.a_at.tolist(), al.b_at.tolist())) == brute_overlaps(a, b)
    groups = brute_groups(a, b)
    assert al.groups == len(groups)
    assert [al.a_group.tolist().count(g) for g in range(al.groups)] == [len(x) for x, _ in groups]
    assert list(zip(*(x.tolist() for x in al.products()))) == [(i, j) for x, y in groups for i in x for j in y]
    text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()
    assert b"".join(T.GroupText(99, 99).pieces(np.arange(len(a)), np.arange(len(b)), al))[:-1] == text


def brute(sides, rows):
    linked, out, library = [], [], Tokenizer.from_file(A)
    library.encode_special_tokens = True
    for _, text in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sides.b.encode(text) if text else []
        ab, bb = [sides.a_bytes[i] for i in a], [sides.b_bytes[i] for i in b]
        if not text or b"".join(ab) != b"".join(bb) or b"".join(ab) != (" " + text).encode():
            linked.append(None)
            continue
        la, lb = [len(x) for x in ab], [len(x) for x in bb]
        groups = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in brute_groups(la, lb))
        linked.append((len(a), len(b), groups.count(";") + 1, [(a[i], b[j]) for i, j in brute_overlaps(la, lb)], hashlib.sha256(groups.encode()).hexdigest()))
    docs = Counter(p for x in linked if x for p in set(x[3]))
    top = Counter()
    for (i, _), n in docs.items():
        top[i] = max(top[i], n)
    for (doc_id, _), x in zip(rows, linked):
        out.append((doc_id, x[0], x[1], x[2], len(x[3]), sum(docs[p] == top[p[0]] for p in x[3]), sum(docs[p] for p in x[3]), x[4]) if x else (doc_id, 0, 0, 0, 0, 0, 0, ""))
    return out


ODD = [None, "", " ", "a", "hello world", "  two  spaces ", "<|endoftext|> and <s> </s> <unk>", "ﬁne ligature", "tab\tand\nline", "東京都 🙂 naïve", "x" * 300, "▁ mark", "ends with space ", "\x00 nul", "<0x41> is not A"]


def test_digest_equals_brute_force(spark, sides, monkeypatch):
    monkeypatch.setattr(T, "BUNDLE", 300)
    r = random.Random(4)
    words = "the of and alignment tokenizers überraschung números 12345 don't été ... (x) naïve".split()
    rows = list(enumerate(ODD + [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(60)])) + [(None, "no id here"), (3, "hello world"), (3, "hello world"), (None, None)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, sha string, n_a int").repartition(4)
    got = [tuple(x) for x in T.alignment_digest(docs, A, B).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(sides, rows)))


def test_one_group_of_copies_and_a_very_long_text(spark, sides):
    rows = [(i, "copies of one text") for i in range(200)] + [(500, "word " * 40_000 + "end")]
    got = {x.doc_id: x for x in T.alignment_digest(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert got[0].count_sum == got[0].n_links * 200 and got[0].n_best == got[0].n_links
    assert got[500].n_groups > 0 and len(got) == 201


def test_empty_table(spark):
    out = T.alignment_digest(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.count() == 0 and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
