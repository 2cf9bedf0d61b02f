import numpy as np
import xxhash
from wordloom.llm import simhash as S


def brute(texts, k=4):
    import re

    out = []
    for t in texts:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def closure(ids, fps, d):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= d:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


TEXTS = [None, "", "  \t\n", "One", "one", "a b c", "a b c d", "A b C d", "é È x y Z q", "w " * 700, "long" * 900 + " a b c d", *[f"tok{i} the of and {i % 7} end of line number {i % 5}" for i in range(60)]]


def test_fingerprints_match_the_plain_library():
    got = S.fingerprints([(t or "").encode() for t in TEXTS], 4)[:, 0]
    assert [int(x) for x in got] == brute(TEXTS)


def test_groups_equal_the_closure_of_all_pairs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_digest(docs).collect()}
    fps = brute(TEXTS)
    assert {i: v[0] for i, v in got.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {i: v[1] for i, v in got.items()} == closure(list(range(len(TEXTS))), fps, 4)


def test_links_of_planted_distances(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for b in base:
        fps.append(int(b))
        for d in (1, 2, 4, 5, 8):
            x = int(b)
            for bit in rng.choice(64, d, replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    classes = spark.createDataFrame([(i, [f]) for i, f in enumerate(signed)], "doc_id long, fp array<long>")
    roots = {r.node: r.root for r in S.components(S.near_links(classes, S.CONTRACT)).collect()}
    want = closure(list(range(len(fps))), fps, 4)
    assert {i: roots.get(i, i) for i in want} == want


def test_empty_table_gives_no_rows(spark):
    assert S.simhash_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_ids_link_and_name_nothing(spark):
    rows = [(None, "a b c d"), (7, "A b C d"), (None, "q r s t u v"), (9, "z y x w")]
    got = [(r.doc_id, r.component_id) for r in S.simhash_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(None, 7), (7, 7), (None, None), (9, 9)], key=repr)
