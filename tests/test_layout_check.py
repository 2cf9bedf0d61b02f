"""Findings of hand-made templates and copies of them."""

import random

import pytest
from wordloom.functions.plans import cut
from wordloom.operators import layout
from wordloom.operators import layout_check as C
from wordloom.plans.fixtures import FILLED, TEMPLATE

LINES = FILLED.split("\n")
CHANGED = "Wszelkie zmiany umowy wymagają zgody wszystkich stron oraz obecności dwóch świadków."
MORE = ["Strony dodają tu zupełnie nowy zapis o ogrodzie.", "(należy opisać powód zgodnie z art. 5 ustawy)", "Zostało jeszcze ………… do wpisania"]
CASES = {
    "filled": FILLED, "template": TEMPLATE, "edited": "\n".join([x if i != 13 else CHANGED for i, x in enumerate(LINES) if i != 4] + MORE), "moved": "\n".join([LINES[13], *LINES[:13], *LINES[14:]]),
    "no caption": "\n".join(x for x in LINES if x != "(imię i nazwisko)"), "empty": "",
}


@pytest.fixture(scope="module")
def checked(spark):
    """Findings and verdict of each case, from one run."""
    docs = cut(layout.blocks(spark.createDataFrame(list(enumerate(CASES.values())), "doc_id long, text string")))
    templates = cut(layout.blocks(spark.createDataFrame([(0, TEMPLATE), (1, ""), (2, "Strony zawierają umowę najmu.")], "doc_id long, text string")))
    number = {n: i for i, n in enumerate(CASES)}
    wanted = [(i, 0) for n, i in number.items() if n != "empty"] + [(number["empty"], 1), (number["empty"], 2)]
    rows, items = ({r.doc_id: r.row for r in d.select("doc_id", "row").distinct().collect()} for d in (docs, templates))
    pairs = spark.createDataFrame([(rows[i], items[j]) for i, j in wanted], "row long, item long")
    found = cut(C.findings(pairs, docs, templates))
    every, verdicts = found.collect(), {(r.row, r.item): r for r in C.verdicts(pairs, found).collect()}
    return lambda name, j=0: ([r for r in every if (r.row, r.item) == (rows[number[name]], items[j])], verdicts[rows[number[name]], items[j]])


def kinds(rows, *names):
    return sorted((r.finding, r.template_p, r.document_p, r.text, r.value) for r in rows if r.finding in names)


def test_a_filled_copy_has_values_and_no_issue(checked):
    rows, verdict = checked("filled")
    values = {r.text: (r.finding, r.value) for r in rows if r.finding in ("filled", "choice", "to_sign", "unfilled", "unresolved")}
    assert values["p1_1"] == ("filled", "5 maja 2024") and values["miejscowosc"] == ("filled", "Krakowie") and values["p3_1"] == ("filled", "Polnej 7") and values["p4_1"] == ("filled", "2000")
    assert values["p5_1"] == values["p5_2"] == ("choice", None)
    assert values["uwagi_stron_do_umowy"] == ("filled", "Strony nie mają uwag.") and values["uwagi_stron_do_umowy_2"] == ("filled", "Najemca obejrzał lokal.")
    assert values["imie_i_nazwisko"] == ("filled", "Jan Kowalski")
    assert [r.finding for r in rows if r.finding in ("missing", "changed", "order", "caption_missing", "residue_note", "residue_blank", "extra")] == []
    assert kinds(rows, "optional_missing") == [("optional_missing", 14, None, "Pełnomocnik stron działa osobiście", None)]
    assert (verdict.issues, verdict.blocking) == (0, False)


def test_the_template_itself_is_unfilled(checked):
    rows, verdict = checked("template")
    assert kinds(rows, "missing", "changed", "order", "extra", "caption_missing") == [] and verdict.blocking
    assert {r.text for r in rows if r.finding == "unfilled"} >= {"p1_1", "p3_1", "p4_1", "imie_i_nazwisko"}
    assert {r.document_p for r in rows if r.finding == "residue_blank"} >= {1, 3, 4}


def test_missing_changed_extra_and_residue(checked):
    rows, verdict = checked("edited")
    assert [x[1] for x in kinds(rows, "missing")] == [4]
    assert [x[1] for x in kinds(rows, "changed")] == [13]
    assert "Strony dodają tu zupełnie nowy zapis o ogrodzie." in {r.text for r in rows if r.finding == "extra"}
    assert [r.text for r in rows if r.finding == "residue_note"] == ["(należy opisać powód zgodnie z art. 5 ustawy)"]
    assert [r.text for r in rows if r.finding == "residue_blank"] == ["Zostało jeszcze ………… do wpisania"]
    assert verdict.blocking and verdict.issues >= 1


def test_order_and_lost_caption(checked):
    assert [x[1] for x in kinds(checked("moved")[0], "order")] == [13]
    assert [(r.template_p, r.text) for r in checked("no caption")[0] if r.finding == "caption_missing"] == [(11, "(imię i nazwisko)")]


@pytest.mark.parametrize("seed", range(5))
def test_rising_is_a_longest_one(seed):
    r = random.Random(seed)
    values = [r.randint(0, 12) for _ in range(11)]
    kept = sorted(C.rising(values))
    picks = [[v for i, v in enumerate(values) if m >> i & 1] for m in range(1 << len(values))]
    longest = max(len(c) for c in picks if all(a < b for a, b in zip(c, c[1:])))
    assert len(kept) == longest and all(values[a] < values[b] for a, b in zip(kept, kept[1:]))


def test_empty_sides(checked):
    rows, verdict = checked("empty", 1)
    assert rows == [] and (verdict.issues, verdict.blocking) == (0, False)
    rows, verdict = checked("empty", 2)
    assert [r.finding for r in rows] == ["missing"] and verdict.blocking
