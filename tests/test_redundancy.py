"""Redundancy rules against a plain loop that rewrites one sentence after the other."""

import random
import re

import pytest
from wordloom.operators import features
from wordloom.operators import redundancy as R

FORMS = [
    ("wykonawca", "wykonawca", "subst:sg:nom:m1"), ("zamawiający", "zamawiający", "subst:sg:nom.voc:m1"), ("generalny", "generalny", "adj:sg:nom:m1:pos"), ("kwotę", "kwota", "subst:sg:acc:f"), ("umowa", "umowa", "subst:sg:nom:f"),
    ("naprawia", "naprawiać", "fin:sg:ter:imperf"), ("zapłacił", "zapłacić", "praet:sg:m1:perf"), ("usuwa", "usuwać", "fin:sg:ter:imperf"), ("określa", "określać", "fin:sg:ter:imperf"), ("proszę", "prosić", "fin:sg:pri:imperf"), ("można", "można", "pred"), ("można", "możny", "adj:sg:nom:f:pos"),
    ("jasny", "jasny", "adj:sg:nom:m3:pos"), ("jasne", "jasny", "adj:pl:nom:n:pos"), ("klarowny", "klarowny", "adj:sg:nom:m3:pos"), ("klarowne", "klarowny", "adj:pl:nom:n:pos"), ("cel", "cel", "subst:sg:nom:m3"), ("zamiar", "zamiar", "subst:sg:nom:m3"), ("rubli", "rubel", "subst:pl:gen:m3"),
]
PAIRS = [("adj", "klarowny", "jasny", False), ("noun", "cel", "zamiar", False), ("adj", "generalny", "jasny", True)]


def tables(spark):
    return spark.createDataFrame(FORMS, "form string, lemma string, tag string"), spark.createDataFrame(PAIRS, "kind string, a string, b string, strong boolean")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, row int").repartition(3)


def run(spark, texts, mode="standard"):
    out = R.chosen(docs(spark, texts), *tables(spark), mode).collect()
    return {(r.doc_id, r.paragraph_index, r.sentence_index): (r.output, r.rule and r.rule.split(":")[1]) for r in out}


def test_a_shared_opening_goes_and_the_next_sentence_sees_the_output(spark):
    text = "Generalny wykonawca naprawia drogę gminną. Generalny wykonawca usuwa wady budynku. Generalny wykonawca usuwa szkody budynku."
    got = run(spark, [(1, text)])
    assert got[1, 0, 0] == ("Generalny wykonawca naprawia drogę gminną.", None)
    assert got[1, 0, 1] == ("Usuwa wady budynku.", "drop_repeated_opening")
    # The sentence before now opens with its verb, so this one keeps its subject.
    assert got[1, 0, 2] == ("Generalny wykonawca usuwa szkody budynku.", None)


def test_one_word_only_in_strong_mode_and_nothing_in_conservative(spark):
    text = "Wykonawca naprawia drogę. Wykonawca, jednak, usuwa wady."
    assert run(spark, [(1, text)])[1, 0, 1][1] is None
    assert run(spark, [(1, text)], "strong")[1, 0, 1] == ("Jednak, usuwa wady.", "drop_repeated_opening")
    assert all(rule is None for _, rule in run(spark, [(1, text)], "conservative").values())


def test_openings_that_stay(spark):
    texts = [
        "Kwotę wykonawca proszę. Kwotę wykonawca proszę wpłacić.",  # an object, and no third person
        "Generalny wykonawca naprawia drogę.\nGeneralny wykonawca usuwa wady.",  # another paragraph
        "Wykonawca naprawia drogę. Generalny wykonawca usuwa wady.",  # another opening
        "Generalny wykonawca naprawia drogę. Generalny wykonawca (usuwa) wady.",  # the rest opens with no word
        "Generalny rubli naprawia drogę. Generalny rubli rubli drogę.",  # no predicate
    ]
    assert all(rule is None for _, rule in run(spark, list(enumerate(texts))).values())


def test_subject_and_doubles_inside_a_sentence(spark):
    texts = [
        (1, "Wykonawca naprawia drogę gminną w całości, oraz wykonawca usuwa wady."),
        (2, "Zapis jest klarowny i jasny oraz klarowne oraz jasne słowa."),
        (3, "To cel i zamiar stron."),
        (4, "Zapis generalny i jasny."),
        (5, "Jasny i klarowny zapis."),
    ]
    got = run(spark, texts)
    assert got[1, 0, 0] == ("Wykonawca naprawia drogę gminną w całości, oraz usuwa wady.", "drop_repeated_subject_in_sentence")
    assert got[2, 0, 0] == ("Zapis jest jasny oraz klarowne oraz jasne słowa.", "drop_tautological_adj_pair")
    assert got[3, 0, 0] == ("To zamiar stron.", "drop_tautological_noun_pair")
    assert got[4, 0, 0][1] is None and run(spark, texts, "strong")[4, 0, 0] == ("Zapis jasny.", "drop_tautological_adj_pair")
    assert got[5, 0, 0] == ("Klarowny zapis.", "drop_tautological_adj_pair")


def test_null_and_repeated_ids_stay_apart(spark):
    text = "Generalny wykonawca naprawia drogę. Generalny wykonawca usuwa wady."
    out = R.chosen(docs(spark, [(None, text), (None, text), (5, text), (5, "Inny tekst.\nDrugi akapit."), (6, None), (7, "")]), *tables(spark)).collect()
    assert len(out) == 8 and len({r.row for r in out}) == 4 and sum(r.rule is not None for r in out) == 3


def plain_loop(paragraphs, mode):
    """The rule of openings as a loop over sentences, written anew without the operator's parts."""
    info = {}
    for form, _, tag in FORMS:
        info.setdefault(form, []).append(tag.split(":"))
    letters = lambda t: re.findall(r"[^\W\d_]+", t)
    endings = sorted("owanie owania owaniu owana owany owane ono ego emu ych ymi ami ach owi owa owy owe ona ony one enie ania anie ę ą a u e y i".split(), key=len, reverse=True)

    def anchors(t):
        out = set()
        for w in letters(t.lower()):
            if len(w) >= 5 and w not in features.LOW_SIGNAL and not w.endswith(("ować", "owić")):
                out.add(next((w[: -len(e)] for e in endings if w.endswith(e) and len(w) - len(e) >= 5), w))
        return out

    results = []
    for sentences in paragraphs:
        every = [a for s in sentences for a in anchors(s)]
        again, previous = len(every) > len(set(every)), None
        for s in sentences:
            out, words = s, letters(s)
            for k in (4, 3, 2, 1)[: 3 if mode == "standard" else 4] if previous and again else ():
                if len(words) <= k or len(words) < 3 or len(letters(previous)) < k:
                    continue
                head = re.match(r"[\W\d_]*" + r"[\W\d_]+".join(map(re.escape, words[:k])), s)[0]
                earlier = re.match(r"[\W\d_]*" + r"[\W\d_]+".join(map(re.escape, letters(previous)[:k])), previous)[0]
                rest = s[len(head) :].lstrip(" ,;:-")
                if len(anchors(head)) != k or anchors(head) != anchors(earlier) or not rest[:1].isalpha():
                    continue
                after = [w.lower() for w in letters(rest)]
                after = after[1:] if after[0] in R.CONNECTORS else after
                tags = info.get(words[0].lower(), [])
                if not any(len(t) > 2 and "nom" in t[2].split(".") for t in tags) or any(t[0] == "pred" for t in tags) or not any(t[0] == "praet" or t[0] == "fin" and t[2] == "ter" for t in info.get(after[0] if after else "", [])):
                    continue
                fresh = rest[0].upper() + rest[1:]
                if fresh != s:
                    out = fresh
                    break
            results.append(out)
            previous = out
    return results


@pytest.mark.parametrize("mode", ["standard", "strong"])
def test_made_paragraphs_equal_the_plain_loop(spark, mode):
    r = random.Random(11)
    openings = ["Generalny wykonawca", "Wykonawca", "Umowa", "Zamawiający generalny", "Kwotę", "Można", "Generalny zamawiający wykonawca umowa"]
    rests = ["naprawia drogę", "usuwa wady", "jednak określa cenę", "proszę wpłacić", "zapłacił"]
    paragraphs = [[f"{r.choice(openings)}{r.choice([' ', ', ', ' - '])}{r.choice(rests)} {r.choice(['gminną', 'szkody budynku', 'dom'])}." for _ in range(r.randint(1, 7))] for _ in range(60)]
    texts = [(i, "\n".join(" ".join(p) for p in paragraphs[i : i + 3])) for i in range(0, 60, 3)]
    got = run(spark, texts, mode)
    want = plain_loop(paragraphs, mode)
    assert [v[0] for _, v in sorted(got.items())] == want and want != [s for p in paragraphs for s in p]
