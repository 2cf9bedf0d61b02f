"""Paragraphs, sentences, tokens, n-grams, normalisation, protection of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.patterns import BLANK
from wordloom.functions.plans import has_rows

LETTERS = r"\p{L}+"
#: The characters of BLANK.
BLANKS = " \t\n\x0b\f\r\xa0"
#: Blanks after a sign of an end; the sign is looked for behind the first blank, so that most characters fail at once.
SENTENCE_GAP = rf"[{BLANK}](?<=[.!?][{BLANK}])[{BLANK}]*(?=\p{{Lu}}|__PROTECTED_)"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), 0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTERS))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words; shifted copies are zipped, so the words are computed a fixed number of times."""
    k = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), k)
    for i in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(i), k), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def paragraph_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n+"), lambda p: p.rlike(f"[^{BLANK}]"))


def sentence_list(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(paragraph, SENTENCE_GAP), strip), lambda s: s != "")


def sentence_gaps(paragraph: Column) -> Column:
    """What stands between the paragraph's sentences."""
    return F.regexp_extract_all(paragraph, F.lit(SENTENCE_GAP), 0)


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index (from 0), text of each non-blank paragraph; a null text has none. A column `row` of docs comes along."""
    keep = ["row"] if has_rows(docs) else []
    # Outer, with the empty row dropped after: an inner explode would have the optimizer split each text twice, to drop empty lists.
    return docs.select(*keep, "doc_id", F.posexplode_outer(paragraph_list(F.col("text"))).alias("paragraph_index", "text")).where("text IS NOT NULL")


def split_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, sentence_index, text of each sentence; a column `row` of docs comes along."""
    p, keep = split_paragraphs(docs), ["row"] if has_rows(docs) else []
    return p.select(*keep, "doc_id", "paragraph_index", F.posexplode_outer(sentence_list(F.col("text"))).alias("sentence_index", "text")).where("text IS NOT NULL")


def ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    """ngram and its count over all documents."""
    words = docs.select(tokens(F.coalesce("text", F.lit(""))).alias("w"))
    made = F.explode_outer("w") if n == 1 else F.explode_outer(ngrams(F.col("w"), n))
    return words.select(made.alias("ngram")).where("ngram IS NOT NULL").groupBy("ngram").agg(F.count("*").alias("n"))


def sentence_openings(docs: DataFrame, length: int = 2) -> DataFrame:
    """The first words of sentences that have that many, and their counts."""
    w = split_sentences(docs).select(tokens(F.col("text")).alias("w")).where(F.size("w") >= length)
    return w.groupBy(F.array_join(F.slice("w", 1, length), " ").alias("opening")).agg(F.count("*").alias("n"))


# Common character references.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&sect;": "§", "&amp;": "&"}
BLOCK_END = r"(?i)<br[^>]*>|</(?:p|div|li|tr|h[1-6])[^>]*>"


def strip_markup(text: Column) -> Column:
    """Block ends become line ends, other tags spaces; references decoded; blanks collapsed; at most one empty line."""
    out = F.regexp_replace(F.regexp_replace(text, BLOCK_END, "\n"), "<[^>]+>", " ")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\x{00A0}]+", " ")
    out = F.array_join(F.transform(F.split(out, "\n"), lambda l: F.regexp_replace(l, r"^[ \r]+|[ \r]+$", "")), "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


#: The heading of the reasoning, also letter-spaced, on a line of its own.
HEADING = "UZASADNIENIE"
REASONING = r"^.*(?:^|\n)[ \t]*" + r"[ \t]*".join(HEADING) + r"[ \t]*(?:\n|$)"
# Lines of a judgment that say nothing of the matter.
BOILERPLATE = (
    r"^\s*(?:sygn\.?\s*akt.*|(?:s\.?s\.?[aonrw]\.?|sędzia|sędziowie|przewodnicząc\p{L}+|protokolant|protokolantka|sprawozdawca|prezes)(?:[^\p{L}\p{N}_].*)?|"
    r"dnia\s+\d.*|na\s+oryginale\s+właściwe\s+podpisy.*|za\s+zgodność.*|[/\-–—_=.\s]*|\d+[.)]?|[IVXLC]+[.)]?)\s*$"
)
# Names that were taken out: an ellipsis in brackets, two initials.
GAP, INITIALS = r"\(\s*\.\.\.\s*\)", r"\p{Lu}\.\s*\p{Lu}\."
ANONYMISED = rf"{GAP}|(?<![\p{{L}}\p{{N}}_]){INITIALS}"


def extract_reasoning(text: Column) -> Column:
    """What follows the last reasoning marker line, or the whole text."""
    return F.regexp_replace(text, f"(?ius){REASONING}", "")


def drop_boilerplate(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda l: ~l.rlike(f"(?iu){BOILERPLATE}")), "\n")


def anonymisation_rate(text: Column) -> Column:
    n = word_count(text)
    return F.when(n > 0, F.round(F.regexp_count(text, F.lit(ANONYMISED)) / n, 4)).otherwise(0.0)


# Fragments whose text must survive an edit; the earlier alternative wins at a place.
PROTECTED = [
    r"(?<![\p{L}\p{N}_])art\.\s*\d+[a-zA-Z]?(?![\p{L}\p{N}_])(?:\s*§\s*\d+[a-zA-Z]?)?",
    r"§\s*\d+[a-zA-Z]?(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])ust\.\s*\d+[a-zA-Z]?(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])pkt\s*\d+[a-zA-Z]?(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])Dz\.\s*U\.[^,.;)]*",
    r"(?<![\p{L}\p{N}_])\d{1,2}[./-]\d{1,2}[./-]\d{2,4}(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}_])\d{4}\s*r(?=\.)",
    r"(?<![\p{L}\p{N}_])(?:\d{1,3}(?:[ \x{00A0}.]\d{3})+(?:,\d+)?|\d+(?:[,.]\d+)?)\s*(?:%|(?:zł(?:ot(?:ych|e|y|ego|ym|ymi))?|PLN|EUR|USD)(?![\p{L}\p{N}_]))",
    r"„[^”]+”",
    r'"[^"]+"',
    r"^\s*(?:\d+\.|[a-z]\)|[ivxlcdm]+\))\s+",
]
#: What a fragment begins with comes first, so that most characters fail at once.
PROTECT = r"(?ium)(?:(?=[audp\d§„\"])|^)(?:" + "|".join(PROTECTED) + ")"


# Masks of an excerpt, in their order.
MASKS = [
    (r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}(?![\p{L}\p{N}_])", "[EMAIL]"),
    (r"(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)?(?![\p{L}\p{N}_])", "[LICZBA]"),
    (r"(?<![\p{L}\p{N}_])(?:[A-ZĄĆĘŁŃÓŚŹŻ][a-ząćęłńóśźż]+(?: +|$)){2,}", "[PODMIOT] "),
]
EXCERPT = 260


def masked_excerpt(text: Column) -> Column:
    """The first sentence with blanks collapsed, 260 characters at most, its addresses, numbers and names masked."""
    flat = strip(F.regexp_replace(text, f"[{BLANK}]+", " "))
    out = F.substring(F.element_at(F.split(flat, r"(?<=[.!?]) +", 2), 1), 1, EXCERPT)
    for pattern, mask in MASKS:
        out = F.regexp_replace(out, pattern, F.lit(mask))
    return strip(out)


# Letters that lose their marks, and what stands for them.
MARKED, PLAIN = "ąćęłńóśźżäöüéèêáíúñçâîôûàù", "acelnoszzaoueeeaiuncaiouau"
SLUG = 48


def slug(text: Column) -> Column:
    """Lower-case letters without marks and digits, joined by hyphens, 48 characters at most."""
    plain = F.translate(F.lower(text), MARKED, PLAIN)
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, SLUG), "-$", "")


def protect(text: Column) -> tuple[Column, Column]:
    """The text with numbered placeholders, and the array of the fragments they stand for, in order."""
    found, gaps = F.regexp_extract_all(text, F.lit(PROTECT), 0), F.split(text, PROTECT, -1)
    name = lambda i: F.format_string("__PROTECTED_%04d__", i)
    head = F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g, i: F.concat(g, name(i)))
    return F.when(F.size(found) > 0, F.concat(F.array_join(head, ""), F.element_at(gaps, -1))).otherwise(text), found


def restore(text: Column, fragments: Column) -> Column:
    """The inverse of protect."""
    parts = F.split(text, r"__PROTECTED_\d{4,}__", -1)
    numbers = F.regexp_extract_all(text, F.lit(r"__PROTECTED_(\d{4,})__"), 1)
    filled = F.zip_with(F.slice(parts, F.lit(1), F.size(numbers)), numbers, lambda g, n: F.concat(g, F.get(fragments, n.cast("int"))))
    return F.when(F.size(numbers) > 0, F.concat(F.array_join(filled, ""), F.element_at(parts, -1))).otherwise(text)


def normalize_spacing(text: Column) -> Column:
    """Runs of 2 or 3 spaces become one, none stand before punctuation, one stands between punctuation and a letter."""
    out = F.regexp_replace(text, r"(?<=\S) {2,3}(?=\S)", " ")
    out = F.regexp_replace(out, r"[ \t]+([,;:!?]|\.(?!\.))", "$1")
    return F.regexp_replace(out, r"([,;:])(\p{L})", "$1 $2")


def plain_dashes(text: Column) -> Column:
    """Long dashes with their blanks become a spaced short dash."""
    return F.regexp_replace(text, r"\s*(?:—|--)\s*", " – ")
