"""Chains of edits and visible differences against plain loops and by hand."""

import random

import pytest
from pyspark.sql import functions as F
from wordloom.operators import changes as C
from wordloom.operators import rewrite

COLUMNS = "row long, step int, paragraph_index int, sentence_index int, before string, after string, rule string"


def plain(edits):
    """Edits in order; each looks for the open end that it continues."""
    out, at_place, at_text = [], {}, {}
    flat = lambda t: " ".join((t or "").split())
    for row, _, p, s, before, after, rule in edits:
        before, after = flat(before), flat(after)
        if not before or not after or before == after:
            continue
        if p is not None and s is not None:
            i = at_place.get((row, p, s))
            i = i if i is not None and out[i][4] == before else None
        else:
            p = s = None
            i = at_text.pop((row, before), None)
        if i is None:
            out.append([row, p, s, before, after, [rule]])
            i = len(out) - 1
        else:
            out[i][4] = after
            out[i][5] = [*out[i][5], rule]
        if p is not None:
            at_place[row, p, s] = i
        else:
            at_text[row, after] = i
    return sorted(repr(tuple(x)) for x in out if x[3] != x[4])


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_the_plain_loop(spark, seed):
    r = random.Random(seed)
    edits = [(r.randint(0, 3), i, r.choice([None, 0, 1]), r.choice([0, 0, None]), r.choice(["A", "B ", "C", "D  x", "", None]), r.choice(["A", "B", " C", "D x"]), f"r{i}") for i in range(260)]
    got = C.collapsed(spark.createDataFrame(edits, COLUMNS).repartition(4)).collect()
    assert sorted(repr((x.row, x.paragraph_index, x.sentence_index, x.before, x.after, x.rules)) for x in got) == plain(edits)


def test_descriptions_by_hand(spark):
    rows = [
        ("Strona ma obowiązek zapłaty.", "Strona musi zapłacić.", "Zastąpiono „ma obowiązek zapłaty” sformułowaniem „musi zapłacić”."),
        ("Ponadto, strona płaci.", "strona płaci.", "Usunięto fragment „Ponadto,”."),
        ("Strona płaci.", "Strona dziś płaci, a potem odbiera.", "Dodano fragment „dziś […] , a potem odbiera”."),
        ("a  b", "a b", "Brak widocznej zmiany."),
        ("x " * 60 + "koniec", "koniec", "Usunięto fragment „" + ("x " * 60)[:89].rstrip() + "…”."),
    ]
    d = spark.createDataFrame([(i, b, a) for i, (b, a, _) in enumerate(rows)], "i int, before string, after string")
    got = C.with_fragments(d).withColumn("d", C.description(F.col("fragments"))).orderBy("i").collect()
    assert [x.d for x in got] == [x[2] for x in rows]


def replay(before, fragments):
    out, at = [], 0
    for f in fragments:
        assert before[f.start : f.end] == f.removed
        out.append(before[at : f.start])
        if f.op == "insert":  # a gap that no fragment holds
            out.append(f" {f.added} ")
        else:
            out.append(f.added)
        at = f.end
    return "".join("".join([*out, before[at:]]).split())


def test_fragments_of_rewritten_documents_replay(spark):
    from wordloom.plans.fixtures import seeded

    docs = seeded(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts, edits = rewrite.stepped(docs)
    assert edits.where("step = 2").count() > 0
    seen = C.visible_changes(edits).collect()
    assert len(seen) > 50 and any(x.steps == 2 for x in seen)
    for x in seen:
        assert replay(x.before, x.fragments) == "".join(x.after.split()) and x.description != C.NOTHING
    # The changes of a document, put in the places of their sentences, give its rewritten text.
    after = {r.row: (r.source, r.text) for r in texts.collect()}
    for x in seen:
        if x.before in (source := " ".join((after[x.row][0] or "").split())) and source.count(x.before) == 1:
            assert x.after in " ".join(after[x.row][1].split())


def test_rows_without_or_with_equal_ids_stay_apart(spark):
    rows = [(None, "Ponadto inny.  Tekst .\n\nDrugi -- wiersz."), (None, "Czwarty tekst ."), (5, "Trzeci tekst."), (5, "Trzeci , tekst."), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.text) for r in rewrite.rewrite(docs).collect()]
    assert sorted(out, key=repr) == sorted([(None, "Ponadto inny.  Tekst.\n\nDrugi – wiersz."), (None, "Czwarty tekst."), (5, "Trzeci tekst."), (5, "Trzeci, tekst."), (6, "")], key=repr)


def test_empty(spark):
    assert C.visible_changes(spark.createDataFrame([], COLUMNS)).count() == 0
