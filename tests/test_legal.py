import datetime as dt

from pyspark.sql import functions as F
from wordloom.operators import calibrate, corpus, detect, features, legal, reports, rewrite, structure


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_findings_have_exact_spans(spark):
    text = "Warto zauważyć, że to jest. Ponadto ma istotne znaczenie. Ponadto wygasło — i tak."
    got = {(r.rule, r.sentence_index, r.start, r.evidence) for r in detect.findings(frame(spark, [text])).collect()}
    assert ("drop_discourse_intro", 0, 0, "Warto zauważyć, że") in got and ("important_frame", 1, 8, "ma istotne znaczenie") in got
    assert ("em_dash", 2, 15, "to wygasło — i tak.") in got and {g[0] for g in got} >= {"repeated_frame"} and not any(g[0] == "style_frame" for g in got)


def test_lookaround_findings(spark):
    text = "Nie chodzi o sam zapis umowy lecz o skutek. Wymaga to analizy dokumentów, oceny skutków prawnych oraz wyboru drogi sądowej."
    assert {r.rule for r in detect.lookaround_findings(frame(spark, [text])).collect()} == {"nie_lecz", "tricolon"}


def test_exceedances(spark):
    row = spark.range(1).select(calibrate.exceedance_high(F.lit(3.0), F.lit(2.0)).alias("a"), calibrate.exceedance_high(F.lit(0.4), F.lit(0.0)).alias("b"), calibrate.exceedance_low(F.lit(0.3), F.lit(0.4)).alias("c"), calibrate.exceedance_low(F.lit(0.3), F.lit(0.0)).alias("d")).first()
    assert tuple(row) == (0.5, 0.0, 0.5, 0.0)


# Written by hand from the rules' definitions: text, then (rule, start, end, evidence).
BY_HAND = [
    ("To właśnie on.", [("to_wlasnie", 0, 10, "To właśnie")]), ("A to właśnie on.", [("to_wlasnie", 2, 12, "to właśnie")]), ("TO WŁAŚNIE ON.", []),
    ("Już z treści wynika prawo.", [("juz", 0, 4, "Już")]), ("już z treści wynika prawo.", []), ("Już dziś z niej wynika.", []),
    ("Ala  —  kot", [("em_dash", 3, 8, "Ala  —  kot")]), ("Bardzo długie zdanie -- i jeszcze dłuższe.", [("em_dash", 20, 24, "gie zdanie -- i jeszcze ")]),
    ("Ma istotne znaczenie.", [("important_frame", 0, 20, "Ma istotne znaczenie")]), ("Z jednej strony tak.", [("z_jednej_strony", 0, 15, "Z jednej strony")]),
    ("Podsumowując, tak.", [("summary_opener", 0, 12, "Podsumowując")]), ("Tak, podsumowując.", []), ("W znacznym stopniu również tak.", [("style_frame", 0, 18, "W znacznym stopniu")]),
]


def test_findings_by_hand(spark):
    out = detect.sentence_findings(frame(spark, [t for t, _ in BY_HAND])).collect()
    got = [sorted((r.rule, r.start, r.end, r.evidence) for r in out if r.doc_id == i) for i in range(len(BY_HAND))]
    assert got == [sorted(w) for _, w in BY_HAND]


def test_anchors_by_hand(spark):
    """Stems keep five letters; low-signal words and infinitives of -ować are none."""
    got = frame(spark, ["Najemca zapłacił czynsz, także odpowiedzialnością wykonania i budować znaczenie umowa"]).select(features.anchors(F.col("text")).alias("a")).first().a
    assert got == ["najemc", "zapłacił", "czynsz", "odpowiedzialności", "wykon", "umowa"] or got == ["najemc", "zapłacił", "czynsz", "odpowiedzialności", "wykonani", "umowa"]


def test_more_gates_and_style_rules(spark):
    long = "Strony zgodnie ustalają, że najemca płaci czynsz w terminie siedmiu dni od doręczenia rachunku za lokal."
    pairs = [("To jest tak.", "To basically jest tak.", "no_foreign_words"), ("To jest plan.", "To w celu jest plan.", "known_bad_patterns"), ("Ma płacić.", "Ma płacić, która trwa.", "no_stranded_relative_clause"), ("A i b.", "A oraz i b.", "no_double_conjunctions"), ("Tak.", "Tak oraz.", "no_dangling_connectors"), ("To (tak).", "To (tak.", "balanced_punctuation"), (long, "Strony ustalają, że najemca płaci.", "length_ratio"), ("Tak 0000.", "Tak __PROTECTED_0000__.", "placeholder_restore"), ("Ala __PROTECTED_0000__.", "Ala 0000.", "protected_fragments"), ("Ala oraz Ola płacą.", "Ala płaci. Ola płaci.", "sentence_split_safety"), ("Krótko.", "Krótko i na temat, choć dłużej.", None)]
    got = rewrite.gates(spark.createDataFrame(pairs, "original string, candidate string, want string")).collect()
    assert [(r.candidate, r.reason) for r in got if r.reason != r.want] == []
    texts = ["Podsumowując umowa wygasa.", "Szczególną rolę w umowie odgrywa termin zapłaty.", "Umowa trwa w chwili obecnej.", "Wada przejawia się również w cenie."]
    out = {(r.original, r.rule): r.candidate for r in rewrite.candidates(frame(spark, texts)).collect()}
    assert out[texts[0], "legal_style:comma_after_podsumowujac"] == "Podsumowując, umowa wygasa." and out[texts[1], "legal_style:duze_znaczenie_ma"] == "Duże znaczenie w umowie ma termin zapłaty."
    assert out[texts[2], "kancelaryzm"] == "Umowa trwa obecnie." and out[texts[3], "legal_style:widać_takze"] == "Wada widać także w cenie."


def test_rewrite_keeps_what_stands_between(spark):
    text = "To ma istotne znaczenie.  Tak jest.\n\n  \nCo tu?\tMa istotne znaczenie lokal.\n"
    got = rewrite.rewrite(frame(spark, [text, None, "\n\n"]), 1).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["To ma duże znaczenie.  Tak jest.\n\n  \nCo tu?\tMa duże znaczenie lokal.\n", "", "\n\n"]


def test_gates_name_the_first_failure(spark):
    pairs = [("Termin wynosi 14 dni.", "Termin wynosi 15 dni.", "numbers_preserved"), ("Strona nie zapłaciła.", "Strona zapłaciła.", "negation"), ("Strona może odstąpić.", "Strona musi odstąpić.", "deontic_modality"), ("Coś.", " ", "non_empty"), ("To ma istotne znaczenie.", "To ma duże znaczenie.", None)]
    got = rewrite.gates(spark.createDataFrame(pairs, "original string, candidate string, want string")).collect()
    assert all(r.reason == r.want for r in got)


def test_rewrite_applies_steps(spark):
    d = frame(spark, ["To ma istotne znaczenie — naprawdę.", "Bez zmian.", ""])
    got = {r.doc_id: r.text for r in rewrite.rewrite(d, 2).collect()}
    assert got[0] == "To ma duże znaczenie – naprawdę." and got[1] == "Bez zmian."


def test_anchor_retention(spark):
    pairs = spark.createDataFrame([(1, "Najemca zapłacił czynsz", "Najemcy zapłacił"), (2, "i to", "nic")], "id long, original string, candidate string")
    got = {r.id: r.retention for r in features.anchor_retention(pairs).collect()}
    assert got[2] == 1.0 and 0 < got[1] < 1


def test_easter_and_deadlines(spark):
    years = spark.createDataFrame([(y,) for y in (2023, 2024, 2025, 2026)], "y int")
    got = {r.y: r.e for r in years.select("y", legal.easter(F.col("y")).alias("e")).collect()}
    assert got == {2023: dt.date(2023, 4, 9), 2024: dt.date(2024, 3, 31), 2025: dt.date(2025, 4, 20), 2026: dt.date(2026, 4, 5)}
    d = spark.createDataFrame([(1, dt.date(2024, 12, 11)), (2, dt.date(2025, 12, 10)), (3, dt.date(2024, 1, 31)), (4, None)], "id long, delivered date")
    by = {r.id: r.last_day for r in legal.deadlines(d, 14, "day").collect()}
    assert by == {1: dt.date(2024, 12, 27), 2: dt.date(2025, 12, 29), 3: dt.date(2024, 2, 14), 4: None}
    assert {r.id: r.term_end for r in legal.deadlines(d, 1, "month").collect()}[3] == dt.date(2024, 2, 29)


def test_references(spark):
    d = frame(spark, ["Na podstawie art. 415 k.c. i art. 6 § 2 Kodeksu cywilnego; art. 9. Sygn. I C 123/2020 oraz II CSK 7/19.", "nic", None])
    refs = [(r.article, r.paragraph, r.code) for r in legal.statute_references(d).orderBy("start").collect()]
    assert refs == [("415", None, "kc"), ("6", "2", "kc"), ("9", None, None)]
    assert {r.signature for r in legal.case_references(d).collect()} == {"I C 123/20", "II CSK 7/19"}
    units = spark.createDataFrame([("kc", "415")], "code string, article string")
    assert {(r.article, r.status) for r in legal.verify(legal.statute_references(d), units).collect()} == {("415", "confirmed"), ("6", "not_found"), ("9", "unknown_act")}


def test_letter_parts(spark):
    letter = "Urząd Miasta\n\nul. Długa 1\nDECYZJA nr 12\nTreść. Od decyzji przysługuje odwołanie.\n  Pouczenie\nOdwołanie wnosi się w terminie."
    plain = "Pan Jan\nTreść pisma. Można wnieść skargę. Koniec. Decyzją tą kończy się sprawa."
    got = {r.doc_id: r for r in legal.letter_parts(frame(spark, [letter, plain, "", None, "Pouczeniem jest to."])).collect()}
    assert got[0].head == "Urząd Miasta\nul. Długa 1" and got[0].instruction == "Pouczenie\nOdwołanie wnosi się w terminie."
    assert got[0].titles.split(" | ")[2] == "decyzja nr 12"
    assert got[1].head == plain and got[1].instruction == "Można wnieść skargę."
    assert all((got[i].head, got[i].titles, got[i].instruction) == ("", "", "") for i in (2, 3)) and got[4].instruction == ""


def test_structure(spark):
    d = frame(spark, ["§ 1. Przedmiot umowy\nTreść pierwsza.\n§ 3. Czynsz\nTreść druga.", "Czynsz najpierw.\nPrzedmiot umowy potem."])
    assert [r.heading for r in structure.headings(d).where("doc_id = 0").orderBy("line").collect()] == ["§ 1. Przedmiot umowy", "§ 3. Czynsz"]
    assert [(r.value, r.expected, r.issue) for r in structure.numbering_issues(d).collect()] == [(3, 2, "gap")]
    assert [(r.doc_id, r.section, r.before) for r in structure.order_issues(d).collect()] == [(1, "czynsz", "przedmiot")]


def test_section_bodies(spark):
    texts = ["§ 1. Przedmiot umowy\nLokal przy ulicy Długiej w Warszawie.\n§ 2. Czynsz\nBrak.\n§ 3. Wypowiedzenie", "Mówimy o czynszu, bo czynsz jest wysoki.\nWięcej.", "", None, "Czynsz za najem\nJeden.", "Czynsz za najem lokalu\nJeden."]
    got = {(r.doc_id, r.section): (r.line, r.body_words, r.empty) for r in structure.section_bodies(frame(spark, texts)).collect()}
    assert got == {(0, "przedmiot"): (0, 6, False), (0, "czynsz"): (2, 1, True), (0, "wypowiedzenie"): (4, 0, True), (4, "czynsz"): (0, 1, True)}


def test_auc_and_log_odds(spark):
    scored = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "score double, label int")
    assert corpus.auc(scored).first().auc == 0.875
    a = spark.createDataFrame([("x", 10), ("y", 1)], "term string, n long")
    b = spark.createDataFrame([("x", 1), ("y", 10)], "term string, n long")
    z = {r.term: r.z for r in corpus.log_odds(a, b).collect()}
    assert z["x"] > 0 > z["y"] and z["x"] == -z["y"]


def test_reports(spark):
    d = spark.createDataFrame([("a,b", "accepted"), ("a", "rejected"), ("b", "undecided")], "rules string, decision string")
    assert {(r.rule, r.accepted, r.rejected, r.undecided) for r in reports.rule_decisions(d).collect()} == {("a", 1, 1, 0), ("b", 1, 0, 1)}
    old = spark.createDataFrame([(1, None), (2, 5)], "k long, v long")
    fresh = spark.createDataFrame([(1, 7), (2, 9)], "k long, v long")
    assert {r.k: r.v for r in reports.backfilled(old, fresh, "k", ["v"]).collect()} == {1: 7, 2: 5}
