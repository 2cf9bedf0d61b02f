"""SQL twins of the text, metric, finding and calibration queries (DuckDB)."""

from __future__ import annotations

from wordloom.functions import patterns as P
from wordloom.operators import calibrate, detect, metrics
from wordloom.operators.text import BOILERPLATE  # noqa: F401  (same pattern on both sides)

from .fixtures import sql_seeded

B = P.BLANK
STRIP = rf"'^[{B}]+|[{B}]+$', '', 'g'"


def sentences(source: str) -> str:
    """CTEs d, p (paragraphs), s (sentences) over a query that gives doc_id and text."""
    return rf"""WITH d AS ({source}),
p0 AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\n+'), lambda x: regexp_replace(x, {STRIP}) <> '') AS l FROM d),
p AS (SELECT doc_id, i::INTEGER AS paragraph_index, l[i + 1] AS text FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM p0)),
s0 AS (SELECT doc_id, paragraph_index, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[{B}]+(\p{{Lu}}|__PROTECTED_)', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: regexp_replace(x, {STRIP})), lambda x: x <> '') AS l FROM p),
s AS (SELECT doc_id, paragraph_index, i::INTEGER AS sentence_index, l[i + 1] AS text FROM (SELECT doc_id, paragraph_index, l, unnest(range(len(l))) AS i FROM s0)),
w AS (SELECT *, len(regexp_extract_all(text, '\p{{L}}+')) AS words FROM s)
"""


DOCS, SEEDED = "SELECT doc_id, text FROM documents", sql_seeded()
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"


def ngram(n: int) -> str:
    return f"SELECT ngram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS ngram FROM (SELECT {TOKENS} AS w FROM documents)) GROUP BY ngram"


def sentence_metrics(source: str, extra: str = "") -> str:
    return sentences(source) + rf"""{extra}, a AS (SELECT doc_id, sum(words)::BIGINT AS words, count(*) AS sentences, avg(CASE WHEN words > 0 THEN words END) AS m0, stddev_pop(CASE WHEN words > 0 THEN words END) AS sd0, count(CASE WHEN words > 0 THEN 1 END) AS k,
  count(DISTINCT array_to_string(string_split_regex(lower(text), '[{B}]+')[1:2], ' ')) AS o FROM w GROUP BY doc_id),
sm AS (SELECT doc_id, words, sentences, round(m, 4) AS mean_sentence_words, CASE WHEN m > 0 THEN round(sd / m, 4) ELSE 0 END AS sentence_length_cv,
  CASE WHEN k >= 3 AND sd + m > 0 THEN round((sd - m) / (sd + m), 4) ELSE 0 END AS sentence_burstiness, round(o / sentences, 4) AS opening_diversity FROM (SELECT *, coalesce(m0, 0) AS m, coalesce(sd0, 0) AS sd FROM a)),
en AS (SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS sentence_entropy FROM (SELECT doc_id, words // 5 AS bin, count(*) AS n FROM w WHERE words > 0 GROUP BY ALL) GROUP BY doc_id),
ps AS (SELECT doc_id, CASE WHEN count(*) >= 3 THEN round(stddev_pop(n) / avg(n), 4) ELSE 0 END AS paragraph_shape_cv FROM (SELECT doc_id, paragraph_index, count(*) AS n FROM w GROUP BY ALL) GROUP BY doc_id),
cd AS (SELECT doc_id, CASE WHEN n > 0 THEN round(c / n * 1000, 4) ELSE 0 END AS connective_density FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\p{{L}}+')) AS n, {P.sql_count("coalesce(text, '')", metrics.CONNECTIVE)} AS c FROM d))
"""


def found_cte() -> str:
    """CTEs up to f: all findings of sentences s, then r: repeated openings, and al: all together."""
    out = [f", mk AS (SELECT *, {P.sql_marked('text')} AS t FROM s)"]
    parts = []
    for i, (family, rule, kind, spec, weight, rewritable) in enumerate(detect.RULES):
        pat = P.sql_pattern(spec)
        column = "text" if "<" not in spec else "t"
        bare = (lambda x: x) if column == "text" else P.sql_bare
        cut = "[1:1]" if kind == "first" else ""
        where = " WHERE start > 2" if rule == "transition" else ""
        only = P.sql_pattern(detect.ONLY_IF.get(rule, spec))
        shown = "evidence"
        if rule in detect.AROUND:
            k = detect.AROUND[rule]
            shown = f"substr(text, greatest(start - {k}, 0) + 1, start + len(evidence) + {k} - greatest(start - {k}, 0))"
        elif rule in detect.ONLY_IF:
            shown = f"regexp_replace(evidence, {STRIP})"
        parts.append(
            f"SELECT doc_id, paragraph_index, sentence_index, '{family}' AS family, '{rule}' AS rule, start, start + len(evidence) AS \"end\", {shown} AS evidence, {weight} AS weight10, {str(rewritable).lower()} AS rewritable, {i} AS ord FROM ("
            f"SELECT doc_id, paragraph_index, sentence_index, text, {bare('m[k]')} AS evidence, len({bare('array_to_string(g[1:k], chr(32) || chr(32))')}) - 2 * (k - 1) + len({bare('array_to_string(m[1:k - 1], chr(32) || chr(32))')}) - 2 * greatest(k - 2, 0) AS start FROM ("
            f"SELECT doc_id, paragraph_index, sentence_index, text, m, g, unnest(range(1, len(m{cut}) + 1)) AS k FROM (SELECT doc_id, paragraph_index, sentence_index, text, regexp_extract_all({column}, '{pat}') AS m, string_split_regex({column}, '{pat}') AS g FROM mk WHERE regexp_matches({column}, '{only}')))){where}"
        )
    out.append(", f0 AS (" + " UNION ALL ".join(parts) + ")")
    vague, nominal = detect.VAGUE, detect.NOMINAL
    out.append(f""", dn AS (SELECT doc_id, paragraph_index, sentence_index, text, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '{vague}'))) AS v, len(list_filter(l, lambda x: len(x) >= {detect.NOMINAL_LETTERS} AND regexp_matches(x, '{nominal}'))) AS q
  FROM (SELECT *, regexp_extract_all(lower(text), '\\p{{L}}+') AS l FROM s))
, f1 AS (SELECT * FROM f0 a WHERE rule <> 'style_frame' OR NOT EXISTS (SELECT 1 FROM f0 b WHERE b.doc_id = a.doc_id AND b.paragraph_index = a.paragraph_index AND b.sentence_index = a.sentence_index AND b.weight10 = 7 AND b.rewritable AND a.start >= b.start AND a.start < b."end")
  UNION ALL SELECT doc_id, paragraph_index, sentence_index, 'vague_reference', 'vague_density', 0, len(text), substr(text, 1, 120), 4, false, 100 FROM dn WHERE n >= {detect.MIN_WORDS} AND v / n >= {detect.VAGUE_RATE}
  UNION ALL SELECT doc_id, paragraph_index, sentence_index, 'nominalization', 'nominal_density', 0, len(text), substr(text, 1, 120), 4, true, 101 FROM dn WHERE n >= {detect.MIN_WORDS} AND q / n >= {detect.NOMINAL_RATE})
, r AS (SELECT doc_id, paragraph_index, sentence_index, key, n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM (SELECT doc_id, paragraph_index, sentence_index, lower(regexp_replace({P.sql_bare(f"regexp_extract(t, '{P.sql_pattern(detect.OPENING)}')")}, '[{B}]+', ' ', 'g')) AS key FROM mk WHERE regexp_matches(t, '{P.sql_pattern(detect.OPENING)}'))) WHERE n >= 2)
, al AS (SELECT * FROM f1 UNION ALL SELECT doc_id, paragraph_index, sentence_index, 'repeated_opening', 'repeated_frame', 0, len(key), key, 6, false, 200 FROM r)
, dw AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\p{{L}}+')) AS words FROM d)
, fr AS (SELECT doc_id, family, n, round(n / words * 1000, 4) AS per_1000_words, round(wt / 10.0, 4) AS weight_total, rewritable FROM (SELECT doc_id, family, count(*) AS n, sum(weight10) AS wt, sum(rewritable::INTEGER)::BIGINT AS rewritable FROM al GROUP BY ALL) JOIN dw USING (doc_id))
""")
    return "".join(out)


def score(weight: str, words: str = "words") -> str:
    return f"CASE WHEN {words} > 0 THEN round(least(1.0, {weight} / 10.0 / {words} * 1000 / {detect.SCALE}), 4) ELSE 0 END"


SIGNAL = f", ds AS (SELECT doc_id, words::BIGINT AS words, coalesce(n, 0)::BIGINT AS findings, {score('coalesce(wt, 0)')} AS signal_score FROM dw LEFT JOIN (SELECT doc_id, count(*) AS n, sum(weight10) AS wt FROM al GROUP BY doc_id) USING (doc_id))"


def observations(name: str) -> str:
    """CTE name: doc_id, signal, value."""
    families = ", ".join(f"'{f}'" for f in calibrate.FAMILIES)
    names = [s for s, _, _ in calibrate.SIGNALS] + ["opening_diversity"]
    rows = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS signal, {n}::DOUBLE AS value FROM dm" for n in names)
    return f""", dm AS (SELECT sm.doc_id, mean_sentence_words, sentence_length_cv, sentence_burstiness, opening_diversity, coalesce(sentence_entropy, 0) AS sentence_entropy, coalesce(paragraph_shape_cv, 0) AS paragraph_shape_cv, connective_density FROM sm LEFT JOIN en USING (doc_id) LEFT JOIN ps USING (doc_id) JOIN cd USING (doc_id) WHERE words > 0)
, {name} AS (SELECT x.doc_id, 'family:' || x.family AS signal, coalesce(per_1000_words, 0)::DOUBLE AS value FROM (SELECT doc_id, unnest([{families}]) AS family FROM dm) x LEFT JOIN fr ON fr.doc_id = x.doc_id AND fr.family = x.family UNION ALL {rows})"""


def distribution() -> str:
    q = ", ".join(f"round(coalesce(quantile_cont(value, {p}), 0), 4) AS p{n}" for p, n in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))
    return f"round(coalesce(avg(value), 0), 4) AS mean, round(coalesce(stddev_pop(value), 0), 4) AS sd, {q}"


def calibrated() -> str:
    """CTEs from the seeded documents to pr (profile of each half: odd ids and all others), cs (signals against the other half's profile) and vd."""
    weight = " ".join(f"WHEN ob.signal = '{n}' THEN {w}" for n, _, w in calibrate.SIGNALS)
    side = " ".join(f"WHEN ob.signal = '{n}' THEN '{s}'" for n, s, _ in calibrate.SIGNALS)
    return sentence_metrics(SEEDED) + found_cte() + SIGNAL + observations("ob") + f"""
, pr AS (SELECT coalesce(doc_id % 2 = 1, false) AS odd, signal, {distribution()} FROM ob WHERE signal <> 'paragraph_shape_cv' OR value > 0 GROUP BY ALL)
, c0 AS (SELECT ob.*, p50, p95, CASE WHEN ob.signal LIKE 'family:%' THEN 1.0 {weight} ELSE 0 END::DOUBLE AS weight, CASE WHEN ob.signal LIKE 'family:%' THEN 'high' {side} ELSE 'none' END AS side FROM ob JOIN pr ON pr.signal = ob.signal AND pr.odd <> coalesce(doc_id % 2 = 1, false)
  WHERE (ob.signal NOT IN ('sentence_burstiness', 'paragraph_shape_cv') OR p50 > 0) AND (ob.signal <> 'paragraph_shape_cv' OR value > 0))
, cs AS (SELECT doc_id, signal, value AS observed, CASE WHEN side = 'low' THEN p50 ELSE p95 END AS baseline, CASE WHEN side = 'high' THEN CASE WHEN value <= greatest(p95, 0.5) THEN 0 ELSE round(least(1.0, (value - greatest(p95, 0.5)) / greatest(p95, 0.5)), 4) END
  WHEN side = 'low' THEN CASE WHEN p50 <= 0 OR value >= p50 THEN 0 ELSE round(least(1.0, (p50 - value) / (0.5 * p50)), 4) END ELSE 0 END::DOUBLE AS exceedance, weight FROM c0)
, vd AS (SELECT doc_id, score, CASE WHEN abs(score - 0.25) <= 0.035 THEN 'borderline' WHEN score >= 0.25 THEN 'above_human_range' ELSE 'within_human_range' END AS verdict FROM (SELECT doc_id, least(1.0, ((4 * sum(round(exceedance * weight * 10000)::BIGINT) + sum((weight * 2)::BIGINT)) // (2 * sum((weight * 2)::BIGINT)))::DOUBLE / 10000.0) AS score FROM cs GROUP BY doc_id))
"""


def twins() -> dict[str, str]:
    cal = calibrated()
    al = sentences(SEEDED) + found_cte()
    return {
        "split_paragraphs": sentences(DOCS) + "SELECT * FROM p",
        "split_sentences": sentences(DOCS) + "SELECT * FROM s",
        "token_counts": ngram(1), "ngram_counts_2": ngram(2), "ngram_counts_3": ngram(3),
        "sentence_openings": sentences(DOCS) + r"SELECT opening, count(*) AS n FROM (SELECT array_to_string(l[1:2], ' ') AS opening FROM (SELECT regexp_extract_all(lower(text), '\p{L}+') AS l FROM s) WHERE len(l) >= 2) GROUP BY opening",
        "sentence_metrics": sentence_metrics(DOCS) + "SELECT * FROM sm",
        "sentence_entropy": sentence_metrics(DOCS) + "SELECT * FROM en",
        "paragraph_shape": sentence_metrics(DOCS) + "SELECT * FROM ps",
        "connective_density": sentence_metrics(SEEDED) + "SELECT * FROM cd",
        "readability": sentences(SEEDED) + r""", sc AS (SELECT doc_id, count(*) AS s FROM w WHERE words > 0 GROUP BY doc_id), t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS l, len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda x: regexp_matches(x, '\p{L}'))) AS ls FROM d)
, k AS (SELECT doc_id, len(l) AS n, ls, len(list_filter(l, lambda x: len(regexp_extract_all(regexp_replace(regexp_replace(x, 'i+([aeouyąęó])', '\1', 'g'), 'i+', 'i', 'g'), '[aeiouyąęó]')) >= 4)) AS hard, len(list_filter(l, lambda x: len(x) > 6)) AS long FROM t)
SELECT doc_id, CASE WHEN n > 0 AND s > 0 THEN round(0.4 * (n / s + 100.0 * hard / n), 2) ELSE 0 END::DOUBLE AS fog_pl, round(greatest(n, 1) / greatest(ls, 1) + 100.0 * long / greatest(n, 1), 2) AS lix FROM k LEFT JOIN sc USING (doc_id)""",
        "findings": al + 'SELECT doc_id, paragraph_index, sentence_index, family, rule, start, "end", evidence, weight10, rewritable FROM al',
        "repeated_openings": al + "SELECT * FROM r",
        "family_rates": al + "SELECT * FROM fr",
        "document_signal": al + SIGNAL + " SELECT * FROM ds",
        "paragraph_diagnosis": al + f", pd AS (SELECT doc_id, paragraph_index, sum(words)::BIGINT AS words, count(*) AS sentences FROM w GROUP BY ALL), pf AS (SELECT doc_id, paragraph_index, count(*) AS n, sum(weight10) AS wt FROM f1 GROUP BY ALL) SELECT doc_id, paragraph_index, words, sentences, coalesce(n, 0)::BIGINT AS findings, {score('coalesce(wt, 0)')} AS signal_score FROM pd LEFT JOIN pf USING (doc_id, paragraph_index)",
        "reference_profile": cal + f"SELECT signal, {distribution()} FROM ob WHERE signal <> 'paragraph_shape_cv' OR value > 0 GROUP BY signal",
        "calibration_signals": cal + "SELECT * FROM cs",
        "calibration": cal + "SELECT * FROM vd",
        "document_diagnosis": cal + "SELECT ds.doc_id, ds.words, findings, signal_score, sentences, mean_sentence_words, sentence_length_cv, sentence_burstiness, opening_diversity, score, verdict FROM ds LEFT JOIN sm USING (doc_id) LEFT JOIN vd USING (doc_id)",
        "review_gate": cal + ", fi AS (SELECT doc_id, family AS first_family FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index, sentence_index, start, ord) AS k FROM al) WHERE k = 1) SELECT doc_id, score, violations, first_family, score >= 0.25 AS needs_revision FROM vd JOIN (SELECT doc_id, sum((exceedance > 0)::INTEGER)::BIGINT AS violations FROM cs GROUP BY doc_id) USING (doc_id) LEFT JOIN fi USING (doc_id)",
        "tone": cal + ", tn AS (SELECT ob.doc_id, ob.signal, value, p50, p95, p95 > 0 AND value > p95 AS high, round(CASE WHEN p95 > 0 AND value > p95 THEN (value - p95) / p95 WHEN value < p50 THEN (p50 - value) / p50 END, 4) AS gap FROM ob JOIN pr ON pr.signal = ob.signal AND pr.odd <> coalesce(doc_id % 2 = 1, false) WHERE ob.signal NOT LIKE 'family:%' AND p50 > 0) SELECT doc_id, signal, CASE WHEN high THEN 'above' ELSE 'below' END AS direction, gap FROM tn WHERE gap >= CASE WHEN (p95 - p50) / p50 < 0.10 THEN 0.50 ELSE 0.15 END",
    }
