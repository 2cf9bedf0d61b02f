import datetime
import math
import random
from collections import defaultdict

import pytest
from wordloom.llm import funnels as M

BASE = datetime.datetime(2024, 1, 1)


def brute(rows, funnels, within, share=50):
    """Straight from the definition: every start looks for its next step among all rows."""
    by = defaultdict(set)
    for client, kind, t in rows:
        if None not in (client, kind, t):
            by[client].add((t, kind))
    out = {}
    for f in funnels:
        for client, es in by.items():
            tries = []
            for t, kind in es:
                if kind == f.steps[0]:
                    times = [t]
                    for step in f.steps[1:]:
                        after = [u for u, k in es if k == step and u > times[-1]]
                        if not after or min(after) - times[-1] > within or any(k in f.excluded and times[-1] < u <= min(after) for u, k in es):
                            break
                        times.append(min(after))
                    tries.append(times)
            if tries:
                n = len(f.steps)
                gaps = [sorted(x[k] - x[k - 1] for x in tries if len(x) > k) for k in range(1, n)]
                out[f.name, client] = [sum(len(x) >= k for x in tries) for k in range(1, n + 1)] + [max(map(len, tries))] + [g[math.ceil(share * len(g) / 100) - 1] if g else None for g in gaps]
    return sorted((f, c, *v, sum(1 for (g, _), w in out.items() if g == f and w[len(fun.steps)] == v[len(fun.steps)])) for (f, c), v in out.items() for fun in funnels if fun.name == f)


def table(spark, rows, kind="timestamp_ntz"):
    data = [(i, None if t is None else BASE + datetime.timedelta(microseconds=t), c, k, 1, 2) for i, (c, k, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"click_id long, ts {kind}, client_id long, kind string, n1 int, cell int").repartition(5)


def events(seed, n=1500, clients=6, span=6000):
    r = random.Random(seed)
    kinds = ["view"] * 5 + ["click"] * 4 + ["purchase", "signup", "error", "other", None]
    rows = [(r.choice([0, 0, 0, *range(1, clients), None]), r.choice(kinds), r.choice([r.randint(0, span) * M.MINUTE // 4, r.randint(0, 40) * 15 * M.MINUTE, None if r.random() < 0.05 else r.randint(0, 10**9)])) for _ in range(n)]
    return rows + rows[:100]


def check(spark, rows, funnels=M.SHOP, within=M.WITHIN, share=50):
    got = M.funnel_report(table(spark, rows), funnels, within, share).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, funnels, within, share), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    check(spark, events(seed))


def test_small_cells_change_nothing(spark, monkeypatch):
    rows = events(7, 900)
    monkeypatch.setattr(M.attempts, "__defaults__", (*M.attempts.__defaults__[:-1], M.MINUTE * 7))
    check(spark, rows)


def test_edges_by_hand(spark):
    m = M.MINUTE
    rows = [
        (1, "view", 0), (1, "click", 15 * m), (1, "view", 30 * m), (1, "purchase", 45 * m),  # every step at the very limit
        (2, "view", 0), (2, "click", 15 * m + 1),  # just over it
        (3, "view", 0), (3, "error", 0), (3, "click", 5), (3, "view", 5),  # an exclusion at the step's own time does not count; equal times never follow each other
        (4, "view", 0), (4, "click", 9), (4, "error", 9),  # one at the next step's time does
        (5, "click", 0), (5, "click", 1), (5, "click", 2), (5, "purchase", 2), (5, "view", 2),
    ]
    got = {(x.funnel, x.client_id): [x.n1, x.n2, x.n3, x.n4, x.deepest, x.t2, x.t3, x.t4] for x in M.funnel_digest(table(spark, rows)).collect()}
    assert got["A", 1] == [2, 1, 1, 1, 4, 15 * m, 15 * m, 15 * m]
    assert got["A", 2] == [1, 0, 0, 0, 1, None, None, None]
    assert got["A", 3] == [2, 1, 0, 0, 2, 5, None, None]
    assert got["A", 4] == [1, 0, 0, 0, 1, None, None, None]
    assert got["C", 5] == [3, 2, 1, 0, 3, 1, 1, None]
    check(spark, rows)


def test_other_funnels_shares_and_zoned_times(spark):
    fs = (M.Funnel("two", ("view", "view")), M.Funnel("one", ("click",), ("view", "error")), M.Funnel("five", ("view", "click", "view", "click", "view"), ("signup", "error")))
    rows = events(5, 700, 3)
    for share in (10, 90, 100):
        got = M.funnel_report(table(spark, rows, "timestamp"), fs[2:], 9 * M.MINUTE, share).collect()
        assert sorted(map(tuple, got)) == brute(rows, fs[2:], 9 * M.MINUTE, share)
    got = {(x.funnel, x.client_id): len(x.gaps) for x in M.attempts(table(spark, rows), fs, M.WITHIN).where("funnel = 'one'").collect()}
    assert got and not any(got.values())


def test_one_client_with_most_rows(spark):
    rows = [(1, "view" if i % 2 else "click", i * 20_000_000) for i in range(6000)] + [(2, "view", 5)]
    got = {(x.funnel, x.client_id): x for x in M.funnel_digest(table(spark, rows)).collect()}
    assert got["A", 1].n1 == 3000 and got["A", 1].n3 == 2999 and got["A", 1].t2 == 20_000_000 and got["A", 2].n1 == 1


def test_empty_table(spark):
    out = M.funnel_digest(table(spark, []))
    assert out.count() == 0 and out.columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
