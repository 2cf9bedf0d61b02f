import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from wordloom.llm import sharding as S


def digest(spark, rows):
    return S.shard_digest(spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, shard int")).collect()


def test_sizes_slots_and_groups(spark):
    rows = [(i, f"text number {i} " + "w" * (i * 37 % 400)) for i in range(6000)] + [(10000 + i, "the same copy " * 20) for i in range(3000)] + [(1, None), (2, ""), (2, "")]
    out = digest(spark, rows)
    assert len(out) == len(rows) and all(r.law == "bytes" and r.grown_shard is None for r in out)
    text = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == text
    slots, sizes, n = defaultdict(list), Counter(), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        n[r.shard] += 1
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= 1.02 * sum(sizes.values()) / 16 and max(n.values()) <= 1.1 * len(rows) / 16


def brute_pack(vectors, shards=16):
    """Greedy packing by the rule, in plain Python: largest share first, highest dot product with what is left."""
    total = [sum(v[d] for v in vectors) or 1 for d in range(3)]
    shares = [[v[d] * shards / total[d] for d in range(3)] for v in vectors]
    left = [[1.0] * 3 for _ in range(shards)]
    out = [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(shares[i]), i)):
        dots = [round(sum(x * y for x, y in zip(l, shares[i])), 12) for l in left]
        out[i] = dots.index(max(dots))
        left[out[i]] = [x - y for x, y in zip(left[out[i]], shares[i])]
    return out


def test_packing_equals_brute_force():
    rng = np.random.default_rng(5)
    units = rng.integers(0, 500, (700, 3)).astype(float)
    assert S.pack(units, 16).tolist() == brute_pack(units.tolist())


@pytest.mark.parametrize("n", [10, 200, 1000, 10000])
def test_groups_stay_whole_at_every_size(spark, n):
    rows = [(i, f"group {i // 3 % max(3, n // 7)} " + "x" * (i // 3 % max(3, n // 7) % 90)) for i in range(n)]
    size, groups = sum(len(t) + 1 for _, t in rows), Counter(t for _, t in rows)
    shards = defaultdict(set)
    for r in digest(spark, rows):
        shards[r.text_crc32].add(r.shard)
    for t, k in groups.items():
        share = max(k * (len(t) + 1) * 16 / size, k * 16 / n, k * len(t.split()) * 16 / sum(len(t.split()) for _, t in rows))
        assert len(shards[zlib.crc32(t.encode())]) == 1 or share > 1


def test_rows_without_ids_of_a_huge_group_are_split(spark):
    out = digest(spark, [(None, "one and the same")] * 3000 + [(i, f"text {i}") for i in range(3000)])
    n = Counter(r.shard for r in out)
    assert len(out) == 6000 and set(n) == set(range(16)) and max(n.values()) <= 1.5 * 6000 / 16


def test_repeats_of_one_id_and_text_are_split_and_reruns_agree(spark, monkeypatch):
    rows = [(7, "one and the same text " * 30)] * 3000 + [(i, f"text {i}") for i in range(10, 310)]
    out = digest(spark, rows)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert len(out) == 3300 and max(sizes.values()) <= 1.25 * sum(sizes.values()) / 16
    monkeypatch.setattr(S, "SLOT_ROWS", 256)  # repeats are counted in parts
    again = digest(spark, rows[::-1])
    assert len(again) == 3300 and Counter((r.doc_id, r.size, r.shard) for r in again) == Counter((r.doc_id, r.size, r.shard) for r in out)


def test_string_ids(spark):
    out = S.shard_digest(spark.createDataFrame([("a", "x y"), ("b", "z"), (None, None)], "doc_id string, text string")).collect()
    assert {r.doc_id for r in out} == {"a", "b", None}


def test_reruns_agree_and_empty(spark):
    rows = [(i, "abc " * (i % 50)) for i in range(500)]
    assert sorted(map(tuple, digest(spark, rows)), key=repr) == sorted(map(tuple, digest(spark, rows[::-1])), key=repr)
    assert digest(spark, []) == []
