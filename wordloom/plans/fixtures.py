"""Our own short Polish fragments, and the seeded view that appends one of them to each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.replies import Catalogue, Kind, Reply

FRAGMENTS = [
    "Warto zauważyć, że strony zawarły umowę. Ponadto najemca zapłacił czynsz 1 500 zł w dniu 12.03.2021. Ponadto oddał klucze.",
    "Z jednej strony termin minął, a z drugiej strony dłużnik zapłacił. W praktyce oznacza to zwłokę. Kluczowe znaczenie ma data.",
    "Nie oznacza to jednak, że roszczenie wygasło. Stanowi jedno z najważniejszych uprawnień wierzyciela na podstawie art. 455 k.c. i § 3 umowy.",
    "Podsumowując, powód ma rację. Zgodnie z art. 6 § 2 Kodeksu cywilnego ciężar dowodu spoczywa na pozwanym. Sygn. I C 123/2020.",
    "Wykonawca musi usunąć wady w terminie 14 dni od doręczenia wezwania. Zamawiający może odstąpić od umowy. Nie wolno przekazywać danych.",
    "§ 1. Przedmiot umowy\nStrony ustalają najem lokalu.\n§ 2. Czynsz\nCzynsz wynosi 2 000 zł.\n§ 4. Wypowiedzenie\nKażda strona może wypowiedzieć umowę.",
    "Od decyzji służy odwołanie do wojewody w terminie 14 dni od dnia doręczenia. Pouczenie: skargę wnosi się za pośrednictwem organu.",
    "Niniejsza umowa ma istotne znaczenie — odgrywa istotną rolę. To właśnie ten zapis i ta klauzula są ważne dla tej sprawy i to on je tworzy.",
    "Realizacja, organizacja i weryfikacja świadczenia wymaga działanie, wykonanie, rozwiązanie oraz zabezpieczenie interesu.",
    "Pozew o zapłatę wnosi powód przeciwko pozwanemu. Wnoszę o zasądzenie kwoty 10.000,50 zł wraz z odsetkami od 1 maja 2022 r.",
    "Dostawca jest zobowiązany dostarczyć towar. Odpowiedzialność ponosi wykonawca. Wynagrodzenie wypłaca się do 10 dnia miesiąca.",
    "Już z umowy wynika obowiązek zapłaty. Nie chodzi o sam termin lecz o skutek umowy. Umowa określa prawa najemcy lokalu, obowiązki wynajmującego lokalu oraz zasady rozliczeń stron.",
    "1. Dostawca wyda towar.\n2. Odbiorca zapłaci cenę.\n4) Strony podpiszą protokół.\n4) Umowa wygasa. Sąd (...) w sprawie A. K. ustalił, że dłużnik zapłacił 300 zł.",
    "I. Kara umowna\nKara umowna wynosi 100 zł.\nII. Czynsz\nCzynsz płaci najemca — zawsze z góry.\nIV. Przedmiot umowy\nPrzedmiotem umowy jest lokal. Podsumowując umowa wygasa w chwili obecnej.",
    "Najemca nie może oddać lokalu w podnajem bez zgody wynajmującego. Kara umowna wynosi 5% ceny. Ustawa z dnia 23 kwietnia 1964 r. (Dz. U. z 2020 r. poz. 1740).",
]


#: Fragments that repeat themselves, and a small dictionary and doublets of our own for the rules that ask for them; users bring theirs.
REDUNDANT = [
    "Generalny wykonawca naprawia drogę gminną. Generalny wykonawca usuwa wady budynku. Generalny wykonawca usuwa szkody budynku.",
    "Wykonawca naprawia drogę gminną w całości, oraz wykonawca usuwa wady. To cel i zamiar stron.",
    "Zapis umowy jest klarowny i jasny. Zamawiający określa cenę. Zamawiający zapłacił cenę.",
    "Należy dokonać analizy. Zarząd ma podjąć uchwałę, a potem dokonać zmiany oraz dokonać wyboru. Strona składa wniosek w celu skorzystania z ulgi.",
    "Dokonano zmiany umowy. Organ sprawuje nadzór bez zwłoki. Spółka płaci w celu uniknięcia zwłoki i w celu spłaty.",
]
FORMS = [
    ("wykonawca", "wykonawca", "subst:sg:nom:m1"), ("zamawiający", "zamawiający", "subst:sg:nom:m1"), ("generalny", "generalny", "adj:sg:nom:m1:pos"), ("naprawia", "naprawiać", "fin:sg:ter:imperf"), ("usuwa", "usuwać", "fin:sg:ter:imperf"), ("określa", "określać", "fin:sg:ter:imperf"),
    ("zapłacił", "zapłacić", "praet:sg:m1:perf"), ("klarowny", "klarowny", "adj:sg:nom:m3:pos"), ("jasny", "jasny", "adj:sg:nom:m3:pos"), ("cel", "cel", "subst:sg:nom:m3"), ("zamiar", "zamiar", "subst:sg:nom:m3"), ("umowy", "umowa", "subst:sg:gen:f"),
    ("składa", "składać", "fin:sg:ter:imperf"), ("płaci", "płacić", "fin:sg:ter:imperf"), ("skorzystania", "skorzystać", "ger:sg:gen:n:perf:aff"), ("uniknięcia", "uniknąć", "ger:sg:gen:n:perf:aff"), ("zwłoki", "zwłoka", "subst:sg:gen:f"), ("z", "z", "prep:gen"), ("bez", "bez", "prep:gen"), ("oraz", "oraz", "conj"),
]
DOUBLETS = [("adj", "klarowny", "jasny", False), ("noun", "cel", "zamiar", False)]


#: A template of our own, and a copy that somebody filled in.
TEMPLATE = "\n".join([
    "UMOWA NAJMU LOKALU MIESZKALNEGO", "zawarta w dniu …… r. w ………… (miejscowość)", "§ 1. Przedmiot umowy", "1. Wynajmujący oddaje najemcy lokal przy ulicy …………", "2. Czynsz wynosi …… zł miesięcznie.", "3. Umowa trwa …… dni / …… miesięcy / czas nieoznaczony",
    "Uwagi stron do umowy:", "………………", "………………", "Dane najemcy", "………………", "(imię i nazwisko)", "§ 2. Postanowienia końcowe", "Wszelkie zmiany umowy wymagają formy pisemnej pod rygorem nieważności.", "Pełnomocnik stron działa osobiście …………… (jeżeli dotyczy)", "…………\t…………", "Wynajmujący\t\tNajemca",
])
FILLED = "\n".join([
    "UMOWA NAJMU LOKALU MIESZKALNEGO", "zawarta w dniu 5 maja 2024 r. w Krakowie", "§ 1. Przedmiot umowy", "1. Wynajmujący oddaje najemcy lokal przy ulicy Polnej 7", "2. Czynsz wynosi 2000 zł miesięcznie.", "3. Umowa trwa 12 miesięcy",
    "Uwagi stron do umowy:", "Strony nie mają uwag.", "Najemca obejrzał lokal.", "Dane najemcy", "Jan Kowalski,", "(imię i nazwisko)", "§ 2. Postanowienia końcowe", "Wszelkie zmiany umowy wymagają formy pisemnej pod rygorem nieważności.", "…………\t…………", "Wynajmujący\t\tNajemca",
])
#: Copies that documents get: filled, the template itself, one that lost a clause and has a note left, one in another order.
COPIES = [
    FILLED, TEMPLATE, "\n".join(x for x in FILLED.split("\n") if not x.startswith("2. ")) + "\n(należy opisać powód zgodnie z art. 5 ustawy)",
    "\n".join([FILLED.split("\n")[13], *(x for i, x in enumerate(FILLED.split("\n")) if i != 13)]),
]


def forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMS, "form string, lemma string, tag string")


def doublets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOUBLETS, "kind string, a string, b string, strong boolean")


def seeded(docs: DataFrame, fragments: list[str] = FRAGMENTS, first: bool = False) -> DataFrame:
    """doc_id and text with fragment doc_id % K on lines of its own, below or (first) above the text."""
    k = len(fragments)
    fragment = F.element_at(F.array(*[F.lit(f) for f in fragments]), (F.pmod("doc_id", F.lit(k)) + 1).cast("int"))
    return docs.select("doc_id", (F.concat(fragment, F.lit("\n"), "text") if first else F.concat("text", F.lit("\n"), fragment)).alias("text"))


def sql_seeded(first: bool = False) -> str:
    listed = ", ".join("'" + f.replace("'", "''") + "'" for f in FRAGMENTS)
    parts = ["text", f"[{listed}][doc_id % {len(FRAGMENTS)} + 1]"]
    return f"SELECT doc_id, {' || chr(10) || '.join(parts[::-1] if first else parts)} AS text FROM documents"


#: A small catalogue of our own for the reply queries; users bring theirs.
CATALOGUE = Catalogue(
    acts=[
        Kind("decyzja", strong=("orzekam", "od decyzji"), weak=("organ",), headers=("decyzja",)),
        Kind("wyrok_zaoczny", strong=("wyrok zaoczny",), headers=("wyrok zaoczny",)),
        Kind("wyrok", strong=("zasądza",), weak=("powód", "pozwan"), headers=("wyrok",)),
        Kind("wezwanie", strong=("wezwani",), weak=("usunąć wady",), headers=("wezwanie", "wezwanie do zapłaty")),
    ],
    senders=[
        Kind("gmina", strong=("wójt",), weak=("wojewod",), procedure="kpa"),
        Kind("sad", strong=("sąd rejonowy", "sąd okręgowy"), weak=("powód",), procedure="kpc"),
    ],
    procedures=[
        Kind("kpa", strong=("k.p.a.", "kodeksu postępowania administracyjnego")),
        Kind("kpc", strong=("k.p.c.", "kodeksu postępowania cywilnego")),
    ],
    replies=[
        Reply("odwolanie", acts=("decyzja",), procedures=("kpa",), remedies=("odwołanie",), term=(14, "day"), ruled_out=("decyzja jest ostateczna",)),
        Reply("skarga", acts=("decyzja",), remedies=("skarga", "skargę"), term=(30, "day"), instruction_only=True),
        Reply("sprzeciw", acts=("wyrok_zaoczny",), remedies=("sprzeciw",), term=(14, "day")),
        Reply("odpowiedz_na_wezwanie", acts=("wezwanie",), term_from_letter=True),
        Reply("wniosek_ogolny"),
    ],
)
