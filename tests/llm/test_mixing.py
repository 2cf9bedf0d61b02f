import random

import pytest
from wordloom.llm import mixing as M


def reshared(sizes, weights=(1, 2, 3)):
    """Targets by sharing out, capping and sharing the excess again until none is above."""
    src = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(src)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in src if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in src}
        capped |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_resharing(spark, seed):
    r = random.Random(seed)
    sizes = {f"0s{i:02d}": r.choice([0, 1, 5, 40, 300, 5000]) for i in range(r.choice([1, 2, 7, 20]))} | {"1": 17}
    got = {t.src: t.target for t in M.source_targets(spark.createDataFrame(list(sizes.items()), "src string, size long")).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_taken_words_come_near_and_reruns_agree(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 30, 200])) if i % 50 else None, r.choice(["a", "b", "c", None, "d"]) if i % 3 else "a", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = M.mixture_digest(docs).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, M.mixture_digest(docs.repartition(7)).collect())) and len(out) == 3000
    source = {i: s for i, _, s, _ in rows}
    taken, target = {}, {}
    for x in out:
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
        target[source[x.doc_id]] = x.target
        assert 0 <= x.taken <= 3 * x.size
    assert all(abs(taken[s] - target[s]) <= 100 for s in taken)


def test_weights_lean_the_sample(spark):
    rows = [(i, "w " * 20, "a" if i % 2 else "b", 9.0 if i % 4 == 0 else 1.0) for i in range(4000)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), weight_col="q").where("src = '0b'").collect()
    heavy = sum(x.copies for x in out if x.doc_id % 4 == 0)
    assert heavy > 1.3 * sum(x.copies for x in out if x.doc_id % 4)


def test_longer_documents_are_likelier_in_the_query(spark):
    rows = [(i, "w " * (10 if i % 2 else 1000), "a" if i % 4 > 1 else "b") for i in range(4000)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("src = '0a'").collect()
    least = min(x.copies for x in out)
    share = {n: sum(x.copies - least for x in out if x.size == n) / sum(1 for x in out if x.size == n) for n in (10, 1000)}
    assert 0 < share[10] < 0.4 * share[1000] < 0.41


def test_rows_without_ids_draw_by_their_texts(spark):
    rows = [(None, "w " * (i % 9 + 1) + f"t{i}", "a" if i % 2 else None) for i in range(300)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 300 and len({x.copies for x in out}) > 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixture_digest(docs).count() == 0
