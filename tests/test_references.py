from wordloom.operators import references as R


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_statutes_are_bound_to_their_act(spark):
    texts = [
        "Zob. art. 6 § 1 i 2 k.c. oraz art. 187 § 1 ust. 2 pkt 3, 4 i 5a Kodeksu postępowania cywilnego. Art. 9 nic.",
        "Pierwsze. Na podstawie art. 5 ustawy z dnia 1 maja (Dz. U. z 2020 r. poz. 1740) płaci.",
        "Stosuje się art. 5 ustawy. Dz. U. z 2020 r. poz. 1740.",
        "Art. 5 rozporządzenia i ustawy Dz.U. 2019 r. Nr 3, poz. 7.",
        "Wstęp.\nArt. 449¹ k.c., art. 449^2 kc i art. 4491 k.c.; art. 12a k. p. a. zwraca.",
        "Art. 7 k.k.w. a art. 8 k.k. Kart. 9 k.c.",
        "Art. 1 i art. 2 ustawy t.j. Dz. U. 2019 r. Nr 3, poz. 7.",
        "", None,
    ]
    got = {}
    for r in R.statutes(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.act, r.article, r.paragraphs, r.passages, r.points, r.flattened))
        assert texts[r.doc_id][r.start : r.end].strip() == r.text
    assert {k: sorted(v) for k, v in got.items()} == {
        0: [(5, "kc", "6", "1,2", "", "", False), (30, "kpc", "187", "1", "2", "3,4,5a", True)],
        1: [(23, "DU/2020/1740", "5", "", "", "", False)],
        4: [(7, "kc", "449_1", "", "", "", False), (23, "kc", "449_2", "", "", "", False), (39, "kc", "4491", "", "", "", True), (55, "kpa", "12a", "", "", "", False)],
        5: [(0, "kkw", "7", "", "", "", False), (16, "kk", "8", "", "", "", False)],
        6: [(9, "DU/2019/7", "2", "", "", "", False)],
    }


def test_cases(spark):
    d = frame(spark, ["Sygn. I  C 123/2020, wyrok KIO 12/21 i SK 3/1999; faktura FV 12/2024, NR 123/2020.", None])
    assert sorted((r.start, r.signature) for r in R.cases(d).collect()) == [(6, "I C 123/20"), (27, "KIO 12/21"), (39, "SK 3/99")]


def test_verdicts_and_trees(spark):
    tree = '{"id": "root", "children": [{"id": "chpt_1", "children": [{"id": "chpt_1-art_6", "children": [{"id": "chpt_1-art_6-par_1"}]}, {"id": "art_449_1"}]}]}'
    trees = spark.createDataFrame([("kc", tree), ("kk", "{broken"), ("kpc", None)], "act string, tree string")
    units = R.tree_units(trees)
    assert {(r.act, r.article) for r in units.collect()} == {("kc", "6"), ("kc", "449_1")}
    refs = R.statutes(frame(spark, ["Art. 6 k.c., art. 6 k.c., art. 4491 k.c., art. 7 k.c., art. 3 k.k., art. 4 k.p."]))
    acts = spark.createDataFrame([("kc", True), ("kk", False)], "act string, available boolean")
    got = {(r.act, r.article): (r.status, r.hint) for r in R.verdicts(refs, units, acts).collect()}
    assert got == {("kc", "6"): ("confirmed", None), ("kc", "4491"): ("not_found", "449_1"), ("kc", "7"): ("not_found", None), ("kk", "3"): ("unavailable", None), ("kp", "4"): ("unknown_act", None)}
