"""Rows without an id, or with one that another has, are documents of their own."""

from wordloom.operators import calibrate, detect, documents, metrics

ROWS = [(None, "Czwarty tekst. Ponadto strona płaci.\nDrugi akapit tu."), (None, "Inny tekst."), (5, "Trzeci tekst. Warto zauważyć, że nic. Warto zauważyć, że coś."), (5, "Ponadto inny. Dodatkowo trzeci."), (6, "Warto zauważyć, że raz.")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_each_row_has_its_own_signal_and_verdict(spark):
    table = documents.document_table(docs(spark))
    assert sorted(r.words for r in documents.signal(table).collect()) == sorted(len([w for w in t.replace(",", "").replace(".", "").split()]) for _, t in ROWS)
    out = calibrate.diagnosis(table).collect()
    assert len(out) == 5 and sorted(str(r.doc_id) for r in out) == ["5", "5", "6", "None", "None"] and all(r.verdict for r in out)
    assert calibrate.review(docs(spark)).count() == 5


def test_openings_repeat_inside_a_row_only(spark):
    found = detect.findings(docs(spark)).where("rule = 'repeated_frame'").collect()
    assert [(r.doc_id, r.sentence_index) for r in sorted(found, key=lambda r: r.sentence_index)] == [(5, 1), (5, 2)]
    assert detect.repeated_openings(docs(spark)).count() == 2
    assert [r.n for r in documents.family_rates(docs(spark)).where("family = 'repeated_opening'").collect()] == [2]


def test_metrics_by_row(spark):
    assert metrics.sentence_metrics(docs(spark)).count() == 5 and metrics.sentence_entropy(docs(spark)).count() == 5 and metrics.paragraph_shape(docs(spark)).count() == 5
    assert sorted((r.words, r.sentences) for r in metrics.sentence_metrics(docs(spark)).collect())[0] == (2, 1)
    assert detect.paragraph_diagnosis(docs(spark)).count() == 6
