import hashlib
import re

import pytest
from wordloom.llm import pii as P

KEY = "k"


def prf(kind, n, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{n}|{half}".encode()).hexdigest()[:12], 16)


def feistel(kind, l, r, a, b):  # noqa: E741
    for n in range(P.ROUNDS):
        if n % 2 == 0:
            l = (l + prf(kind, n, r)) % a  # noqa: E741
        else:
            r = (r + prf(kind, n, l)) % b
    return l, r


def permuted(kind, d):
    n = len(d)
    k = n // 2
    l, r = feistel(f"{kind}:{n}", int(d[:k]), int(d[k:]), 10**k, 10 ** (n - k))  # noqa: E741
    return f"{l:0{k}d}{r:0{n - k}d}"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(reversed(d))) % 10


def card(m):
    d = re.sub("[^0-9]", "", m)
    if luhn(d):
        return m
    b = permuted("card", d[:-1])
    d = iter(b + str(-luhn(b + "0") % 10))
    return re.sub("[0-9]", lambda _: next(d), m)


def run(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    return [(r.text, [(f.kind, f.pseudonym) for f in r.found]) for r in P.pseudonymise(rows, KEY).orderBy("doc_id").collect()]


def test_cards_equal_brute_force_and_stay_valid(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "4111111111111112"]
    out = run(spark, [f"a {c} b" for c in cards])
    assert [t for t, _ in out] == [f"a {card(c)} b" for c in cards]
    assert all(luhn(re.sub("[^0-9]", "", f[0][1])) == 0 for _, f in out[:4]) and out[4][1] == []
    assert re.sub("[^0-9]", "", out[0][0]) == re.sub("[^0-9]", "", out[1][0])


def test_formats_and_links(spark):
    values = {"ipv4": "192.168.1.77", "ssn": "078-05-1120", "phone": "+1 (266) 555-7228", "email": "the.72@mail3.example.com", "iban": "DE89370400440532013000"}
    for kind, v in values.items():
        (a, fa), (b, fb) = run(spark, [f"x {v}, y {v}", f"{v}"])
        assert [k for k, _ in fa] == [kind, kind] and fa[0] == fa[1] == fb[0], kind
        assert fa[0][1] != v and re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]+" if kind == "ipv4" else "[0-9]", "0", fa[0][1]))) == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]+" if kind == "ipv4" else "[0-9]", "0", v)))
        assert a == f"x {fa[0][1]}, y {fa[0][1]}" and b == fa[0][1]
    iban = run(spark, ["DE89370400440532013000"])[0][0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_dates_stay_dates(spark):
    out = run(spark, ["2021-02-28", "28.02.2021", "28/02/2021", "2021-02-30", "1.43.173"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", out[0][0]) and out[0][0] != "2021-02-28"
    y, m, d = out[0][0].split("-")
    assert out[1][0] == f"{d}.{m}.{y}" and out[2][0] == f"{d}/{m}/{y}"
    assert out[3] == ("2021-02-30", []) and out[4] == ("1.43.173", [])


def test_dates_in_other_layouts(spark):
    iso = run(spark, ["2021-12-25"])[0][0]
    y, m, d = iso.split("-")
    name = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"][int(m) - 1]
    texts = ["12/25/2021", "25/12/2021", "December 25, 2021", "25 December 2021", "Dec. 25, 2021", "on 25. December, 2021."]
    want = [f"{m}/{d}/{y}", f"{d}/{m}/{y}", f"{name} {int(d)}, {y}", f"{int(d)} {name} {y}", f"{name[:3]}. {int(d)}, {y}", f"on {int(d)}. {name}, {y}."]
    assert [t for t, _ in run(spark, texts)] == want
    a, b = run(spark, ["3/4/2020", "2020-04-03"])
    assert [int(x) for x in a[0].split("/")] == [int(x) for x in b[0].split("-")][::-1]
    for text in ("25/25/2021", "May 35, 2021", "mayor 2021", "0/0/2020"):
        assert run(spark, [text]) == [(text, [])]


def test_key_comes_from_the_session_or_is_new(spark):
    docs = spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string")
    one, other = P.pii_digest(docs).first(), P.pii_digest(docs).first()
    assert one.text != other.text
    spark.conf.set(P.KEY_SETTING, "held")
    try:
        assert P.pii_digest(docs).first() == P.pii_digest(docs).first() == P.pii_digest(docs, "held").first()
    finally:
        spark.conf.unset(P.KEY_SETTING)


def test_feistel_is_a_bijection(spark):
    from pyspark.sql import functions as F

    d = spark.range(700).select(P.feistel(KEY, F.lit("t"), F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(100), F.lit(7)).alias("s"))
    assert d.distinct().count() == 700


@pytest.mark.parametrize("text", [None, "", "no values", "12 3.4 @ a@b 99", "x" * 300000 + " 4111111111111111"])
def test_odd_texts(spark, text):
    out = run(spark, [text])[0]
    assert (out[0] == text) == (not out[1])


def test_empty_table(spark):
    assert P.pii_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
