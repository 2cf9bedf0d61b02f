import hashlib
import random
import re

from wordloom.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(13, len(v))
            grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    ids.add(str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "É", "é", "a1", "x", "and", "b2", "word", "test", "the"])
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 5, 13, 14, 30])))) for k in range(12)] + [(20, None), (21, ""), (22, "..."), (100, "The É the")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "the"), (None, items[3][1])]
    for i in range(4, 80):
        parts = [" ".join(word() for _ in range(r.randint(0, 40))), r.choice(items[:12])[1].upper() if i % 3 else "", " ".join(word() for _ in range(r.randint(0, 300 if i % 7 == 0 else 5)))]
        docs.append((i, ", ".join(parts)))
    return [*docs, docs[9], (9, "repeated id")], items


def test_digest_equals_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in [*items, items[0]]], "item_id long, text string, doc_id int")
    assert sorted((tuple(r) for r in D.contamination_digest(d, b).collect()), key=repr) == brute(docs, items)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in D.contamination_digest(d, b).collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination_digest(d, b).count() == 0 and D.contamination_digest(one, b).first().n_hit == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha x x x x x x x x x beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    assert {r.doc_id for r in D.near_hits(d, b, 6).collect()} == {1, 3}


def test_string_item_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([("b-1", "two three"), ("a", "one")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.items_sha256) for r in D.contamination_digest(docs, items).collect()}
    assert got[1] == (3, __import__("hashlib").sha256(b"a,b-1").hexdigest()) and got[2][0] == 0
