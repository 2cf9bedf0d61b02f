import random
from collections import defaultdict
from difflib import SequenceMatcher
from statistics import median

from wordloom.operators import sections as S

STEMS = ["Przedmiot umowy", "Wynagrodzenie", "Wynagrodzenie i płatności", "Kary umowne", "Kara umowna", "Termin", "Terminy", "Termin wykonania", "Odpowiedzialność", "Postanowienia końcowe", "Rozwiązanie umowy", "Poufność", "Siła wyższa", "Umowa nr 4/2026", "Straße", "STRASSE", "Rady", "Rada", "Praw", "Prawa"]


def same(a, b):
    a, b = a.casefold(), b.casefold()
    return a in b or b in a or SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.75


def loop(documents):
    """The sequential reading: [(founder, {heading: first}, documents, positions)]."""
    groups = []
    for d, headings in enumerate(documents):
        seen = set()
        for p, h in enumerate(headings):
            i = next((i for i, g in enumerate(groups) if any(same(h, v) for v in g["variants"])), None)
            if i is None:
                groups.append({"founder": (d, p), "variants": [], "documents": 0, "positions": []})
                i = len(groups) - 1
            if h not in groups[i]["variants"]:
                groups[i]["variants"].append(h)
            groups[i]["positions"].append(p)
            groups[i]["documents"] += i not in seen
            seen.add(i)
    return groups


def made(rng, count):
    """Headings drawn from stems, with letters changed, so that a wording moves between groups when it is read again."""
    out = []
    for _ in range(count):
        h = rng.choice(STEMS)
        if rng.random() < 0.6:
            at = rng.randrange(len(h))
            h = h[:at] + rng.choice("aeiouwyz ") + h[at + rng.randrange(2) :]
        out.append(" ".join(h.split()) or "Rada")
    return [h[0].upper() + h[1:] for h in out]


def test_groups_equal_the_sequential_reading_on_1000_headings(spark):
    rng = random.Random(11)
    documents = [made(rng, 8) for _ in range(125)]
    docs = spark.createDataFrame([(i, "\n".join(f"§ {k}. {h}" for k, h in enumerate(hs, 1)), 1) for i, hs in enumerate(documents)], "doc_id long, text string, row int")
    want = loop(documents)
    member = S.members(docs)
    got = defaultdict(set)
    for v in S.variants(member).collect():
        got[v.section.doc, v.section.position].add(v.heading)
    assert got == {g["founder"]: set(g["variants"]) for g in want}
    assert len(want) > 8 and sum(len(g["variants"]) for g in want) > len({h for g in want for h in g["variants"]})  # some wording is in two sections
    rows = {(r.first_doc_id, r.first_position): r for r in S.sections(docs).collect()}
    for g in want:
        r = rows[g["founder"]]
        plain = [h for h in g["variants"] if not any(c.isdigit() for c in h)]
        assert (r.documents, r.median_position, r.kept) == (g["documents"], median(g["positions"]), bool(plain))
        assert r.label == (min(plain, key=len) if plain else g["variants"][0])
        assert r.severity == ("required" if g["documents"] / 125 >= 0.8 else "expected")


def test_links_lose_no_pair(spark):
    rng = random.Random(3)
    words = {h.casefold() for h in made(rng, 400)} | {"a", "b", "ab", "ba", "abc", "abd", "xbxc", "aaaaaaaa", "aaaaaa", "ab ab ab", "abab", "żółw", "zolw"}
    got = {(r.wording, r.like) for r in S.links(spark.createDataFrame([(w,) for w in words], "wording string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and same(a, b)}


def test_titles_numbers_and_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, "UMOWA NAJMU\n§ 1. Czynsz\nNajemca płaci co miesiąc.\nII. Inne warunki\n3) Liczba stron"), (None, "§ 1. Czynsz"), (None, "§ 1. Czynsz"), (1, "§ 2. Czynsz"), (2, None), (3, ""), (4, "x. " * 30000 + "\n§ 9. Kaucja")], "doc_id long, text string"
    )
    assert sorted((r.heading, r.position) for r in S.places(docs).where("NOT at.none AND at.doc = 1").collect()) == [("Czynsz", 0), ("Czynsz", 0), ("Inne warunki", 1), ("Liczba stron", 2)]
    by = {r.label: r for r in S.sections(docs).collect()}
    assert (by["Czynsz"].documents, by["Czynsz"].share, by["Czynsz"].severity) == (4, round(4 / 7, 4), "expected") and by["Kaucja"].documents == 1
    assert S.sections(docs.limit(0)).collect() == []


def test_numbering_of_most_documents(spark):
    mine = lambda texts: S.numbering(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).first().numbering
    assert mine(["§ 1. A", "x\n  § 2", "§ 3", "§ 4", "I. Kara"]) == "paragraph" and mine(["§ 1", "I. Kara", "1. Cena"]) is None and mine(["1. Cena", "2) Termin"]) == "arabic"
    assert mine(["§ 1\nI. Kara", "§ 2\nII. Cena"]) == "roman" and mine([]) is None and mine([None]) is None
