"""Links of headings: what bounds the ratio loses none, and pairs of wordings are no rows of a join."""

import random
from difflib import SequenceMatcher

import numpy as np
from wordloom.operators import sections as S


def made(seed, count, most):
    r = random.Random(seed)
    out = {"".join(r.choice("aaeeno trsżß") for _ in range(r.randint(1, most))) for _ in range(count)}
    for w in sorted(out)[:60]:  # copies with some letters changed
        out |= {"".join(r.choice("aenż") if r.random() < share else c for c in w) for share in (0.1, 0.2, 0.3)}
    return sorted(out)


def test_no_pair_of_the_ratio_is_ruled_out():
    for words in (made(1, 150, 20), made(2, 80, 150), ["", "a", "ab"], [chr(1000 + i) * 3 + "x" for i in range(100)] + ["\U0001f600ab", "\U0001f600ac"]):
        ratio = lambda i, j: SequenceMatcher(None, words[i], words[j], autojunk=False).ratio()  # noqa: B023, E731
        want = {(i, j) for i in range(len(words)) for j in range(i) if max(ratio(i, j), ratio(j, i)) >= S.SAME}
        whole = np.arange(len(words))
        pairs = list(S.near_pairs(words, whole, whole))
        got = {(max(p), min(p)) for p in pairs}
        assert want <= got and len(got) == len(pairs)
        one, two = whole[whole % 3 == 0], whole[whole % 3 != 0]
        apart = {(max(p), min(p)) for p in S.near_pairs(words, one, two)}
        assert apart == {(i, j) for i, j in got if (i % 3 == 0) != (j % 3 == 0)}


def test_letters_in_order_are_those_of_the_plain_bound():
    words = [w for w in made(3, 60, 140) if w]
    codes, size, _ = S._coded(words)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    common = S._in_order(S._bits(codes), codes, a, b)
    ok = (2 * common >= S.SAME * (size[a] + size[b])) | (common == np.minimum(size[a], size[b]))
    assert all(S.may_be_alike(words[i], words[j]) == k for i, j, k in zip(a, b, ok))


def test_no_join_makes_rows_of_pairs_of_wordings(spark, monkeypatch):
    """Wordings that share most pairs of letters, and are not alike: a join on these pairs made a row for each two of them."""
    r = random.Random(4)
    parts = ["th", "er", "on", "an", "in", "re", "at", "en"]
    words = {"".join(r.choice(parts) for _ in range(25)) for _ in range(300)}
    plans, real = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    got = S.links(spark.createDataFrame([(w,) for w in words], "wording string")).collect()
    assert not any("array_intersect" in p for p in plans) and "FlatMapGroupsInPandas" in plans[-1]
    ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    some = sorted(words)[:40]
    assert {(x.wording, x.like) for x in got if x.wording in some and x.like in some} == {(a, b) for a in some for b in some if a != b and (a in b or b in a or ratio(a, b) >= S.SAME)}
