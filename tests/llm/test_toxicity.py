import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from wordloom.llm import toxicity as T


def corpus(n=900):
    r = random.Random(8)
    bad = ["idiot", "scum", "réeuxel", "réeuxon", "moron"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [f"w{r.randint(0, 400)}" for _ in range(r.randint(5, 60))] + (r.sample(bad, 3) if toxic else [])
        r.shuffle(w)
        docs.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_rows_and_odd_texts(spark):
    docs, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, "w1 " * 40000), (3, "second row"), (None, "idiot scum moron")]
    d = spark.createDataFrame([(i, t, 0.5) for i, t in docs + odd], "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame(labels + [(2, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = T.toxicity_digest(d, lab).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)


def brute(docs, labels):
    """Score of each text by comparing it with every example, word for word."""
    find = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    texts = dict(docs)
    rows = sorted((i, y) for i, y in labels.items() if i in texts)
    df = Counter(w for _, t in docs for w in find(t))
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1

    def weight(w):
        base = math.log((len(docs) + 1) / (df[w] + 1)) + 1e-6
        a, b = (sum(1 for i, y in rows if y == s and w in find(texts[i])) + 0.5 for s in (1, 0))
        if a + b == 1:
            return base
        return base * (1 + max(0.0, (math.log(a / (n1 + 1)) - math.log(b / (n0 + 1))) / math.sqrt(1 / a + 1 / b)))

    weights = {w: weight(w) for w in df}

    def unit(t):
        v = {w: (1 + math.log(n)) * weights[w] for w, n in find(t).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else v

    units = {i: unit(texts[i]) for i, _ in rows}
    prior = n1 / len(rows)

    def vote(q, without=None):
        cos = sorted((-round(sum(q.get(w, 0) * x for w, x in units[i].items()), 9), i, y) for i, y in rows if i != without)
        cos = [(-c, y) for c, _, y in cos if c < 0][: T.NEIGHBOURS]
        return (sum(c * y for c, y in cos) + T.PRIOR_WEIGHT * prior) / (sum(c for c, _ in cos) + T.PRIOR_WEIGHT)

    x = np.array([vote(units[i], i) for i, _ in rows])
    xs, ys = T.isotonic(x, np.array([float(y) for _, y in rows]), np.ones(len(rows)))
    return [(i, float(np.interp(vote(unit(t)), xs, ys))) for i, t in docs]


def test_whole_operator_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8)
    monkeypatch.setattr(T, "SEED_BLOCKS", 2)
    docs, labels = corpus(260)
    docs += [(900, ""), (901, "unheard words only"), (902, "w1 w2 idiot")]
    y = {i: t for i, _, t in labels}
    got = {r.doc_id: r for r in T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for i, score in brute(docs, y):
        assert abs(got[i].score - score) < 1e-6, i
    assert len(got[902].examples) == T.NEIGHBOURS and list(got[902].cosines) == sorted(got[902].cosines, reverse=True) and not len(got[900].examples)


def test_a_sample_within_its_bytes(spark):
    docs, labels = corpus(200)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = T.fit(d, lab, per_class=30, sample_bytes=2000)
    size = {i: len(t) for i, t in docs}
    for y in (0, 1):
        mine = m.ids[m.labels == y].tolist()
        assert 0 < len(mine) <= 30 and sum(size[i] for i in mine) <= 2000


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in T.toxicity_digest(d, none).collect()} == {0.5}
    assert T.toxicity_digest(d.limit(0), none).count() == 0


def test_few_labels_and_rare_words_count(spark):
    """Six toxic examples of three words, two of each: too few for a z-score of 3."""
    calm = lambda i: " ".join(f"plain{(i * 7 + k) % 40}" for k in range(12))
    bad = ["vermin", "moron", "lowlife"]
    rows = [(i, f"{calm(i)} {bad[i % 3]}" if i < 6 else calm(i)) for i in range(52)] + [(100 + k, f"{calm(k + 9)} {w}") for k, w in enumerate(bad)] + [(200, calm(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(52)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.toxicity(docs, labels).collect()}
    assert min(got[100 + k] for k in range(3)) >= 0.7 > got[200]
