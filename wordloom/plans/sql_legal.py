"""SQL twins of the corpus, feature, structure, reference, deadline and report queries (DuckDB)."""

from __future__ import annotations

from wordloom.functions import patterns as P
from wordloom.operators import corpus, detect, features, legal, structure
from wordloom.operators import sections as learnt
from wordloom.operators import text as T

from . import sql_text as S
from .fixtures import FRAGMENTS, sql_seeded
from .legal_queries import FORBIDDEN, PREFERRED, STATUSES

TOK = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"


def log_odds(min_count: int, by: str = "") -> str:
    """Over CTEs a (by, term, n) and b (term, n): the rows of corpus.log_odds."""
    g = f"{by}, " if by else ""
    if by:
        j = f"SELECT a.{by}, a.term, a.n AS ca, coalesce(b.n, 0) AS cb, sum(a.n) OVER (PARTITION BY a.{by}) AS na, (SELECT sum(n) FROM b) AS nb FROM a LEFT JOIN b ON a.term = b.term"
    else:
        j = "SELECT term, ca, cb, sum(ca) OVER () AS na, sum(cb) OVER () AS nb FROM (SELECT coalesce(a.term, b.term) AS term, coalesce(a.n, 0) AS ca, coalesce(b.n, 0) AS cb FROM a FULL JOIN b ON a.term = b.term)"
    return f"""SELECT {g}term, round(dl / sqrt(1.0 / (2 * ca + cb) + 1.0 / (2 * cb + ca)), 4) AS z, round(dl, 4) AS log_odds, ca AS count_a, cb AS count_b FROM (
  SELECT *, ln((2 * ca + cb)::DOUBLE / (na + na + nb - (2 * ca + cb))) - ln((2 * cb + ca)::DOUBLE / (nb + na + nb - (2 * cb + ca))) AS dl FROM ({j}) WHERE ca + cb >= {min_count} AND na > 0 AND nb > 0)"""


def terms(source: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"SELECT {g}term, count(*) AS n FROM (SELECT {g}unnest({TOK}) AS term FROM {source}) GROUP BY ALL"


def inventory(category: str) -> str:
    pattern = features.INVENTORY[category].replace("(?iu)", "(?i)").replace("'", "''")
    return f"array_to_string(list_sort(list_transform(regexp_extract_all(coalesce(text, ''), '{pattern}'), lambda x: lower(x))), ' | ') AS {category}"


def sections() -> str:
    out = []
    for name, _, severity, phrases in structure.SECTIONS:
        at = "coalesce(" + ", ".join(f"nullif(instr(t, '{p}'), 0) - 1" for p in phrases) + ", NULL)"
        out.append(f"SELECT doc_id, '{name}' AS section, CASE WHEN {at} IS NOT NULL THEN 'present' ELSE 'missing_{severity}' END AS status, {at}::INTEGER AS position FROM x")
    return f"WITH d AS ({S.SEEDED}), x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM d), sc AS ({' UNION ALL '.join(out)})"


def family() -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{f}' AS family, " + " + ".join(f"contains(t, '{w}')::INTEGER" for w in ws) + " AS n FROM x" for i, (f, ws) in enumerate(structure.FAMILIES))
    return f"""WITH d AS ({S.SEEDED}), x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM d), r AS ({rows}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rank) AS k, lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC, rank) AS second FROM r)
SELECT doc_id, CASE WHEN n > 0 THEN family ELSE 'client_communication' END AS family, CASE WHEN n > 0 THEN round(least(0.98, 0.52 + 0.08 * n + 0.08 * greatest(0, n - second)), 2) ELSE 0.34 END::DOUBLE AS confidence FROM k WHERE k = 1"""


def category() -> str:
    hit = lambda ws: "(" + " + ".join(f"contains(t, '{w}')::INTEGER" for w in ws) + ")"
    rows = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, CASE WHEN {hit(need)} > 0 THEN 3 + 3 * {hit(strong)} + {hit(weak)} ELSE 0 END AS score FROM x" for c, strong, weak, need in structure.CATEGORIES)
    return f"""WITH d AS ({S.SEEDED}), x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM d), r AS ({rows}), k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, category)),
y AS (SELECT *, score < 3 OR (second >= 3 AND score - second <= 2) AS open FROM k WHERE k = 1)
SELECT doc_id, CASE WHEN open THEN 'nieokreslony' ELSE category END AS category, score::INTEGER AS score, CASE WHEN open THEN 0.0 WHEN score >= 9 THEN 0.92 ELSE 0.63 END::DOUBLE AS confidence FROM y"""


def headings() -> str:
    """CTEs up to h: doc_id, line, heading."""
    numbered = r"(?i)^(?:§\s*\d+[a-z]?\.?|[IVXLC]+\.|\d+(?:\.\d+)*[.)]?|art\.\s*\d+[a-z]?\.?)(?:\s+\S.*)?$"
    t = f"regexp_replace(text, {S.STRIP})"
    return S.sentences(S.SEEDED) + rf""", h0 AS (SELECT doc_id, paragraph_index AS line, {t} AS heading FROM p), h AS (SELECT * FROM h0 WHERE len(heading) <= {structure.MAX_HEADING} AND heading <> '' AND (
  (regexp_matches(heading, '{numbered}') AND NOT regexp_matches(heading, ';$') AND NOT (regexp_matches(heading, '\.$') AND regexp_matches(heading, '\s')))
  OR (NOT regexp_matches(heading, ':\s*\S|_{{4,}}|\.{{4,}}') AND NOT regexp_matches(heading, '[.,;:]$') AND regexp_matches(heading, '^\p{{Lu}}'))))"""


def learnt_numbering() -> str:
    flags = ", ".join(f"bool_or(regexp_matches(x, '{p}'))::BIGINT AS {u}" for u, p in learnt.UNITS.items())
    sums = ", ".join(f"coalesce(sum({u}), 0)::BIGINT AS {u}" for u in learnt.UNITS)
    return f"""WITH d AS ({S.SEEDED}), l AS (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), {S.STRIP}) AS x FROM d), f AS (SELECT {flags} FROM l GROUP BY doc_id),
k AS (SELECT count(*) AS documents, {sums} FROM f), b AS (SELECT *, greatest({', '.join(learnt.UNITS)}) AS m FROM k)
SELECT documents, {', '.join(learnt.UNITS)}, CASE WHEN documents = 0 OR m / documents < {learnt.REQUIRED} THEN NULL WHEN roman = m THEN 'roman' WHEN paragraph = m THEN 'paragraph' ELSE 'arabic' END AS numbering FROM b"""


def section_bodies() -> str:
    phrases = ", ".join(f"('{name}', {j}, '{p}')" for name, _, _, listed in structure.SECTIONS for j, p in enumerate(listed))
    return headings() + rf""", ln AS (SELECT p.doc_id, p.paragraph_index AS line, p.text, h.heading IS NOT NULL AS is_h, len(regexp_extract_all(p.text, '[^{S.B}]+')) AS n FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.line = p.paragraph_index),
st AS (SELECT doc_id, section, phrase, line, text, is_h FROM ln, (VALUES {phrases}) v(section, j, phrase) WHERE contains(lower(text), phrase) QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY j, line) = 1),
ti AS (SELECT doc_id, section, line FROM st WHERE is_h AND (regexp_matches(text, '{structure.UNIT}') OR len(regexp_extract_all(replace(lower(text), phrase, ' '), '\p{{L}}+')) <= {structure.EXTRA_WORDS})),
nh AS (SELECT ti.doc_id, ti.section, ti.line, coalesce(min(h.line), 1e9) AS a FROM ti LEFT JOIN h ON h.doc_id = ti.doc_id AND h.line > ti.line GROUP BY ALL),
ns AS (SELECT nh.doc_id, nh.section, nh.line, nh.a, coalesce(min(st.line), 1e9) AS b FROM nh LEFT JOIN st ON st.doc_id = nh.doc_id AND st.line > nh.line GROUP BY ALL),
bo AS (SELECT ns.doc_id, ns.section, ns.line, coalesce(sum(ln.n), 0)::BIGINT AS body_words FROM ns LEFT JOIN ln ON ln.doc_id = ns.doc_id AND ln.line > ns.line AND ln.line < greatest(ns.a, ns.b) GROUP BY ALL)
SELECT *, body_words < {structure.MIN_BODY} AS empty FROM bo"""


def holidays(years: str) -> str:
    """CTEs ho: day, from a query of years."""
    fixed = " UNION ALL ".join(f"SELECT year, make_date(year, {m}, {d}) AS day FROM ey" for m, d in legal.HOLIDAYS)
    return f"""yy AS ({years}), e1 AS (SELECT year, year % 19 AS a, year // 100 AS b, year % 100 AS c FROM yy),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS hh FROM e1), e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - hh - c % 4) % 7 AS k FROM e2),
e4 AS (SELECT year, hh + k - 7 * ((a + 11 * hh + 22 * k) // 451) + 114 AS n FROM e3), ey AS (SELECT year, make_date(year, n // 31, n % 31 + 1) AS easter FROM e4),
ho AS (SELECT DISTINCT year, day FROM ({fixed} UNION ALL SELECT year, (easter + 1)::DATE FROM ey UNION ALL SELECT year, (easter + 60)::DATE FROM ey UNION ALL SELECT year, make_date(year, 12, 24) FROM ey WHERE year >= {legal.EVE_SINCE}))"""


def deadlines(step: str) -> str:
    return f"""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS delivered, (o_orderdate::DATE + {step})::DATE AS term_end FROM orders), {holidays('SELECT DISTINCT y AS year FROM (SELECT year(term_end) AS y FROM o UNION ALL SELECT year(term_end) + 1 FROM o)')},
dd AS (SELECT term_end, (term_end + k::INTEGER)::DATE AS day FROM (SELECT DISTINCT term_end FROM o), range(10) r(k)), l AS (SELECT term_end, min(day) AS last_day FROM dd WHERE dayofweek(day) NOT IN (0, 6) AND day NOT IN (SELECT day FROM ho) GROUP BY term_end)
SELECT id, delivered, term_end, last_day, (last_day - term_end)::INTEGER AS moved FROM o JOIN l USING (term_end)"""


def letter_parts() -> str:
    flat = lambda v: f"lower(regexp_replace(regexp_replace({v}, '[{S.B}]+', ' ', 'g'), {S.STRIP}))"
    strip = lambda v: f"regexp_replace({v}, {S.STRIP})"
    return rf"""WITH d AS ({S.SEEDED}), x AS (SELECT doc_id, text, string_split_regex(text, '{legal.LINE_END}') AS l FROM (SELECT doc_id, coalesce(text, '') AS text FROM d)),
h AS (SELECT *, list_filter(l, lambda v: {strip('v')} <> '')[1:{legal.HEAD_LINES}] AS f FROM x),
t AS (SELECT *, coalesce(list_position(list_transform(f, lambda v: len({flat('v')}) <= {legal.TITLE_CHARS} AND regexp_matches({flat('v')}, '^(?:{'|'.join(legal.TITLES)})(?:[^\p{{L}}]|$)')), true), 0) AS title_at,
  regexp_extract(text, '(?ims){legal.INSTRUCTION}', 1) AS headed, string_split(regexp_replace(text, '([.!?])[{S.B}]+(\p{{Lu}}|__PROTECTED_)', '\1' || chr(31) || '\2', 'g'), chr(31)) AS sent FROM h)
SELECT doc_id, coalesce(array_to_string(CASE WHEN title_at > 0 THEN f[1:title_at - 1] ELSE f END, chr(10)), '') AS head,
  coalesce(array_to_string(list_transform(list_filter(l[1:{legal.TITLE_LINES}], lambda v: len({strip('v')}) BETWEEN 1 AND {legal.TITLE_CHARS}), lambda v: {flat('v')}), ' | '), '') AS titles,
  CASE WHEN headed <> '' THEN headed ELSE coalesce(array_to_string(list_filter(sent, lambda v: regexp_matches(v, '(?i){'|'.join(legal.GRANTS)}')), ' '), '') END AS instruction FROM t"""


def outcomes() -> str:
    """CTEs o (outcomes made from the documents) and rd (with readiness)."""
    pick = lambda xs, k: "[" + ", ".join(f"'{x}'" for x in xs) + f"][({k}) % {len(xs)} + 1]"
    return f"""WITH b AS (SELECT *, coalesce(doc_id, 0) AS i, coalesce(n_chars, 0) AS n FROM documents), o AS (SELECT doc_id, lang, {pick(STATUSES, 'n // 7')} AS status, CASE WHEN i % 3 = 0 THEN '' ELSE coalesce(source, '') END AS model,
  {pick(['model', 'rules_fallback', 'rules'], 'i')} AS backend, i % 5 = 0 AS needs_review, n % 3 AS unresolved, i % 2 AS warnings, n AS words, n % 4 AS changes_applied, n % 6 AS findings_before, n % 2 AS findings_after, n % 5 AS model_segments, n % 9 AS rule_segments,
  i % 4 AS model_rejections, i % 6 AS model_errors, (n % 100) / 100.0::DOUBLE AS signal_before, (n % 50) / 100.0::DOUBLE AS signal_after, (i % 10) / 20.0::DOUBLE AS risk,
  [{pick(['spacing', 'em_dash', 'office'], 'i')}, {pick(['spacing', 'frame'], 'n')}] AS rules, {pick(['accepted', 'rejected', 'undecided'], 'n')} AS decision FROM b),
rd AS (SELECT *, CASE WHEN status <> 'ok' THEN 'failed' WHEN needs_review OR unresolved > 0 OR warnings > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS readiness FROM o)"""


def units(numbering: str) -> str:
    """Lines with their unit numbers, and those that are not one above the unit before."""
    roman = "list_sum(list_transform(range(1, len(raw) + 1), lambda k: CASE WHEN k < len(raw) AND v[raw[k]] < v[raw[k + 1]] THEN -v[raw[k]] ELSE v[raw[k]] END))"
    value = f"(SELECT {roman} FROM (SELECT MAP {{'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100}} AS v))" if numbering == "roman" else "raw"
    return S.sentences(S.SEEDED) + rf""", u AS (SELECT doc_id, paragraph_index AS line, regexp_extract(regexp_replace(text, {S.STRIP}), '{structure.UNITS[numbering]}', 1) AS raw FROM p),
uv AS (SELECT doc_id, line, raw, ({value})::BIGINT AS value FROM u WHERE raw <> ''), ub AS (SELECT *, lag(value) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM uv)
SELECT doc_id, line, raw, value, b + 1 AS expected, CASE WHEN value <= b THEN 'repeat' ELSE 'gap' END AS issue FROM ub WHERE value <> b + 1"""


def plain_markup(text: str) -> str:
    out = f"regexp_replace(regexp_replace({text}, '{T.BLOCK_END}', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    for name, char in T.ENTITIES.items():
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    out = rf"regexp_replace({out}, '[ \t\x{{00A0}}]+', ' ', 'g')"
    out = rf"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: regexp_replace(l, '^[ \r]+|[ \r]+$', '', 'g')), chr(10))"
    return rf"regexp_replace(regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g'), {S.STRIP})"


def articles() -> str:
    """CTE ar: doc_id, article, code of each article."""
    body = r"art\.\s*(\d+[a-z]?)(?:\s*§\s*(?:\d+[a-z]?))?(?:\s*ust\.\s*(?:\d+[a-z]?))?(?:\s*pkt\s*(?:\d+[a-z]?))?"
    code = legal.CODE.replace("(?iu)^", "").replace("(?iu)", "")
    forms = " ".join(f"WHEN form = '{f}' THEN '{k}'" for f, k in legal.CODES.items())
    return rf"""WITH d AS ({S.SEEDED}), m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?i)(?:^|[^\p{{L}}\p{{N}}_]){body}(?:{code})?')) AS t FROM d),
fm AS (SELECT doc_id, regexp_extract(t, '(?i){body}', 1) AS article, lower(regexp_extract(t, '(?i){body}(?:{code})', 2)) AS form FROM m),
ar AS (SELECT doc_id, article, CASE {forms} WHEN contains(form, 'cywiln') THEN 'kc' WHEN contains(form, 'pracy') THEN 'kp' WHEN contains(form, 'karn') THEN 'kk' END AS code FROM fm)"""


K = len(FRAGMENTS)


def terms_listed() -> list[tuple[str, str, str]]:
    rows = [("section", n, p) for n, _, _, ps in structure.SECTIONS for p in ps] + [("family", n, p) for n, ps in structure.FAMILIES for p in ps]
    return rows + [("category", n, p) for n, *pss in structure.CATEGORIES for ps in pss for p in ps]


def signed_modality() -> str:
    left = P.sql_bare(f"regexp_replace({P.sql_marked('text')}, '{P.sql_pattern(features.PROHIBITION)}', ' ', 'g')")
    n = lambda spec, col="text": P.sql_count(col, spec)
    negated = lambda spec: f"({n('<nie_' + spec[1:], 'l')} + {n('<nie_' + chr(92) + 'p{L}+_' + spec[1:], 'l')} - {n('<nie_tylko_' + spec[1:], 'l')})"
    duty, must = negated(features.DUTY), negated("<należy>")
    return f"WITH d AS ({S.SEEDED}), x AS (SELECT doc_id, text, {left} AS l FROM (SELECT doc_id, coalesce(text, '') AS text FROM d)) SELECT doc_id, ({n(features.PROHIBITION)} + {must})::INTEGER AS prohibitions, ({n(features.PERMISSION, 'l')} + {duty})::INTEGER AS permissions, ({n(features.OBLIGATION, 'l')} - {duty} - {must})::INTEGER AS obligations FROM x"


def more(base: dict[str, str]) -> dict[str, str]:
    o, word = outcomes(), r"\p{L}\p{N}_"
    n = lambda flag: f"coalesce(sum(({flag})::INTEGER), 0)::BIGINT"
    total = lambda c, where="true": f"coalesce(sum(CASE WHEN {where} THEN {c} END), 0)::BIGINT AS {c}"
    ok = "status = 'ok'"
    mean = lambda x, where: f"round(coalesce(avg(CASE WHEN {where} THEN {x} END), 0), 4)"
    rate = lambda g: f"1000 * sum(CASE WHEN lang = '{g}' THEN changes_applied END) / sum(CASE WHEN lang = '{g}' THEN words END)"
    modal = " OR ".join(f"regexp_matches({P.sql_marked('term')}, '{P.sql_pattern(p)}')" for p in (features.PROHIBITION, features.PERMISSION, features.OBLIGATION))
    listed = ", ".join(f"'{x}'" for x in corpus.REFERENCE_WORDS + corpus.AMOUNT_DATE_WORDS)
    one = ", ".join(f"'{x}'" for x in corpus.ONE_LETTER)
    remedy, seeded = legal.REMEDY, S.SEEDED
    term = legal.TERM.replace("(?iu)", "(?i)")
    amount = legal.AMOUNT.replace("(?iu)", "(?i)").replace(r"(?![\p{L}])", r"(?:[^\p{L}]|$)")
    distinct = lambda p, col="text": f"coalesce((SELECT string_agg(x, '; ' ORDER BY k) FROM (SELECT x, min(k) AS k FROM (SELECT unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT regexp_extract_all({col}, '{p}', 1) AS l)) GROUP BY x)), '')"
    boiler = T.BOILERPLATE
    email, number, name = (
        rf"\x1e[{word}]+\x1f(?:[.+-]+\x1e[{word}]+\x1f)*@\x1e[{word}]+\x1f(?:[.-]+\x1e[{word}]+\x1f)*\.\x1e[A-Za-z]{{2,}}\x1f", r"\x1e\d+\x1f(?:[.,]\x1e\d+\x1f)?", r"(?:\x1e[A-ZĄĆĘŁŃÓŚŹŻ][a-ząćęłńóśźż]+\x1f(?: +|$)){2,}"
    )
    flat = f"regexp_replace(regexp_replace(coalesce(text, ''), '[{S.B}]+', ' ', 'g'), {S.STRIP})"
    first = rf"left(string_split(regexp_replace({flat}, '([.!?]) +', '\1' || chr(29)), chr(29))[1], {T.EXCERPT})"
    masked = P.sql_marked(first)
    for pattern, mask in ((email, "[EMAIL]"), (number, "[LICZBA]"), (name, "[PODMIOT] ")):
        masked = f"regexp_replace({masked}, '{pattern}', '{mask}', 'g')"
    titled = sql_seeded(first=True)
    plain = f"translate(lower(coalesce(text, '')), '{T.MARKED}', '{T.PLAIN}')"
    return {
        "rule_decisions": o + ", e AS (SELECT unnest(rules) AS rule, decision FROM o) SELECT rule, " + ", ".join(f"{n(f'decision = {chr(39)}{x}{chr(39)}')} AS {x}" for x in ("accepted", "rejected", "undecided")) + " FROM e GROUP BY rule",
        "readiness": o + " SELECT doc_id, readiness FROM rd",
        "flow_summary": o + f" SELECT count(*) AS items, {n(ok)} AS ok, {n('status <> ' + chr(39) + 'ok' + chr(39))} AS failed, {n(ok + ' AND needs_review')} AS needs_review, {n('readiness = ' + chr(39) + 'ready' + chr(39))} AS ready, {n('readiness = ' + chr(39) + 'ready_with_warnings' + chr(39))} AS ready_with_warnings, "
        + ", ".join(total(c, ok) for c in ("words", "changes_applied", "findings_before", "findings_after")) + f", {mean('signal_before', ok)} AS mean_signal_before, {mean('signal_after', ok)} AS mean_signal_after, {mean('signal_after - signal_before', ok)} AS mean_signal_delta FROM rd",
        "ai_use_summary": o + f" SELECT coalesce((SELECT string_agg(model, ', ' ORDER BY model) FROM (SELECT DISTINCT model FROM o WHERE {ok} AND model <> '')), '') AS models, {n('model_segments > 0')} AS documents_with_model_edits, " + ", ".join(total(c) for c in ("model_segments", "rule_segments", "model_rejections", "model_errors")) + f", {n('backend = ' + chr(39) + 'rules_fallback' + chr(39))} AS model_unavailable FROM o WHERE {ok}",
        "benchmark_summary": o + " SELECT count(*) AS runs, " + ", ".join(f"{n(f'status = {chr(39)}{x}{chr(39)}')} AS {x}" for x in ("ok", "failed_safety", "failed_quality", "model_unavailable")) + f", {total('changes_applied')}, {total('model_rejections')}, {mean('risk', 'changes_applied > 0')} AS average_risk FROM o",
        "quality_summary": o + " SELECT status, count(*) AS runs, round(avg((changes_applied > 0)::INTEGER), 4) AS changed_share, round(avg(changes_applied), 4) AS mean_changes, round(avg(signal_before - signal_after), 4) AS mean_gain FROM o GROUP BY status",
        "edit_rates": o + f", r AS (SELECT {rate('en')} AS a, {rate('de')} AS b FROM o) SELECT round(a, 2) AS edits_per_1k, round(b, 2) AS edits_per_1k_against, round(round(a, 2) / greatest(b, 0.01), 2) AS edit_ratio FROM r",
        "style_statistics": rf"WITH x AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[A-Za-zĄ-ż]+') AS w, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[{S.B}]+', '\1' || chr(31), 'g'), chr(31)), lambda s: regexp_replace(s, {S.STRIP}) <> '')) AS s FROM documents) SELECT round(sum(len(w)) / sum(s), 2) AS mean_sentence_words, round((SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM x)) / sum(len(w)), 4) AS type_token_ratio, round(sum(len(w)) / count(*), 2) AS mean_document_words FROM x",
        "rule_separation": S.sentences(S.SEEDED) + S.found_cte() + f", wm AS (SELECT doc_id % {K} < 5 AS model, sum(words) AS words FROM dw GROUP BY ALL), rc AS (SELECT rule, sum((doc_id % {K} < 5)::INTEGER) AS na, sum((doc_id % {K} >= 5)::INTEGER) AS nb FROM f1 GROUP BY rule), rr AS (SELECT rule, 1000 * na / (SELECT words FROM wm WHERE model) AS a, 1000 * nb / (SELECT words FROM wm WHERE NOT model) AS b, 1000 * greatest(nb::DOUBLE, 0.1) / (SELECT words FROM wm WHERE NOT model) AS c FROM rc) SELECT rule, round(a, 4) AS model_rate, round(b, 4) AS human_rate, round(a / c, 4) AS ratio FROM rr WHERE round(a / c, 4) >= 3",
        "protected_terms": f"SELECT DISTINCT term FROM (SELECT unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS term FROM (SELECT {TOK} AS l FROM ({seeded}))) WHERE list_has_any(string_split(term, ' '), [{listed}]) OR len(list_filter(string_split(term, ' '), lambda x: len(x) = 1 AND x NOT IN ({one}))) > 0 OR {modal}",
        "backfilled_labels": "SELECT doc_id, coalesce(quality, n_chars, 0)::BIGINT AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)",
        "family_profile": f"SELECT doc_id, family, CASE WHEN family = 'filing_official' THEN 'profile:' || family ELSE 'uncalibrated' END AS profile FROM ({family()})",
        "document_facts": rf"WITH d AS ({seeded}), c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:^|[^{word}])art\.\s*\d+'))::BIGINT AS articles, len(regexp_extract_all(text, '(?:^|[^{word}])[IVXLC]+\s+[A-Z][A-Za-z]{{0,4}}\s+\d{{1,6}}/(?:\d{{4}}|\d{{2}})(?:$|[^0-9])'))::BIGINT AS cases, {P.sql_count('text', remedy)}::BIGINT AS remedies FROM d) SELECT * FROM c WHERE articles + cases + remedies > 0",
        "roman_units": units("roman"), "arabic_units": units("arabic"), "paragraph_units": units("paragraph"),
        "document_check": f"SELECT doc_id, missing_required, missing_expected, coalesce(e, 0) AS empty, coalesce(n, 0) AS numbering, coalesce(r, 0) AS order, missing_required + coalesce(e, 0) > 0 AS blocking FROM (SELECT doc_id, sum((status = 'missing_required')::INTEGER)::BIGINT AS missing_required, sum((status = 'missing_expected')::INTEGER)::BIGINT AS missing_expected FROM ({base['section_check']}) GROUP BY doc_id) "
        f"LEFT JOIN (SELECT doc_id, count(*) AS e FROM ({base['section_bodies']}) WHERE empty GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({base['numbering_issues']}) GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS r FROM ({base['order_issues']}) GROUP BY doc_id) USING (doc_id)".replace("AS order,", 'AS "order",'),
        "corpus_partition": f"WITH d AS ({titled}), x AS (SELECT doc_id, lower(coalesce(list_filter(string_split_regex(coalesce(text, ''), '\\n+'), lambda l: regexp_replace(l, {S.STRIP}) <> '')[1], '')) AS t FROM d) SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{name}'" for name, ws in structure.PARTITIONS) + f" ELSE '{structure.REST}' END AS part FROM x",
        "classify_cascade": f"SELECT doc_id, CASE WHEN recall >= 0.5 OR (category = 'nieokreslony' AND item_id IS NOT NULL) THEN 'template:' || item_id ELSE category END AS category, CASE WHEN recall >= 0.5 THEN 'template' WHEN category <> 'nieokreslony' THEN 'signals' WHEN item_id IS NOT NULL THEN 'template_share' ELSE 'none' END AS by FROM ({base['classify_category']}) LEFT JOIN ({base['nearest_template'].replace('>= 0.4', '>= 0.25').replace('FROM documents)', f'FROM ({seeded}))')}) USING (doc_id)",
        "signed_modality": signed_modality(),
        "style_profile": rf"WITH fa AS ({family()}), tp AS (SELECT family AS kind, count(*) AS documents FROM fa GROUP BY family HAVING count(*) >= 5 ORDER BY documents DESC, kind LIMIT 1), mi AS (SELECT * FROM ({seeded}) WHERE doc_id IN (SELECT doc_id FROM fa JOIN tp ON family = kind)), "
        rf"x AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[A-Za-zĄ-ż]+') AS w, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[{S.B}]+', '\1' || chr(31), 'g'), chr(31)), lambda s: regexp_replace(s, {S.STRIP}) <> '')) AS s FROM mi), sg AS ({S.sentences('SELECT doc_id, text FROM mi') + S.found_cte() + S.SIGNAL} SELECT max(signal_score) AS m FROM ds) "
        "SELECT kind, documents, (SELECT count(*) FROM fa) - documents AS excluded, (SELECT round(sum(len(w)) / sum(s), 2) FROM x) AS mean_sentence_words, (SELECT round((SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM x)) / sum(len(w)), 4) FROM x) AS type_token_ratio, (SELECT round(sum(len(w)) / count(*), 2) FROM x) AS mean_document_words, (SELECT m >= 0.5 FROM sg) AS warned FROM tp",
        "entry_problems": f"WITH t AS (SELECT DISTINCT unnest({TOK}) AS term FROM ({seeded})), e AS (SELECT term, ['word', 'opening_2', 'phrase'][len(term) % 3 + 1] AS kind, ['accepted', 'rejected', 'candidate', 'lost'][len(term) % 4 + 1] AS status, ['', 'usual', ' '][(len(term) + 1) % 3 + 1] AS note, term IN ({listed}) OR (len(term) = 1 AND term NOT IN ({one})) OR {modal} AS protected FROM t), "
        "p AS (SELECT term, CASE WHEN kind = 'phrase' THEN 'unknown kind' WHEN status = 'lost' THEN 'unknown status' WHEN status = 'accepted' AND protected THEN 'a protected term is accepted' WHEN status = 'rejected' AND trim(note) = '' THEN 'rejected without a reason' END AS problem FROM e) SELECT * FROM p WHERE problem IS NOT NULL",
        "deadline_status": f"SELECT id, last_day, (last_day - DATE '1996-01-15')::INTEGER AS days_left, CASE WHEN last_day < DATE '1996-01-15' THEN 'passed' WHEN last_day = DATE '1996-01-15' THEN 'today' WHEN last_day - DATE '1996-01-15' <= 7 THEN 'soon' ELSE 'open' END AS status FROM ({deadlines('14')})",
        "catalogue_terms": f"WITH d AS (SELECT lower(coalesce(text, '')) AS t FROM ({seeded})), c AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in terms_listed()) + ") v(catalogue, name, term)) SELECT catalogue, name, term, (SELECT count(*) FROM d WHERE contains(t, term)) AS documents FROM c",
        "slugs": f"SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace({plain}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), {T.SLUG}), '-$', '') AS slug FROM documents",
        "masked_excerpts": f"SELECT doc_id, regexp_replace({P.sql_bare(masked)}, {S.STRIP}) AS excerpt FROM ({seeded})",
        "strip_markup": f"SELECT page_id, {plain_markup('html')} AS plain FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)",
        "drop_boilerplate": f"SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(coalesce(text, ''), '(?is){T.REASONING}', ''), chr(10)), lambda l: NOT regexp_matches(l, '(?i){boiler}')), chr(10)) AS body FROM documents",
        "anonymisation_rate": rf"SELECT doc_id, CASE WHEN n > 0 THEN round(k / n, 4) ELSE 0 END::DOUBLE AS rate FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\p{{L}}+')) AS n, len(regexp_extract_all(coalesce(text, ''), '{T.GAP}')) + len(regexp_extract_all(coalesce(text, ''), '(?:^|[^{word}]){T.INITIALS}')) AS k FROM documents)",
        "verify_references": articles() + ", un AS (SELECT * FROM (VALUES ('kc', '6'), ('kc', '415'), ('kpc', '187')) v(code, article)) SELECT doc_id, code, article, CASE WHEN EXISTS (SELECT 1 FROM un WHERE un.code = a.code AND un.article = a.article) THEN 'confirmed' WHEN a.code IN (SELECT code FROM un) THEN 'not_found' ELSE 'unknown_act' END AS status FROM (SELECT DISTINCT doc_id, code, article FROM ar) a",
        "letter_facts": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM ({seeded})) SELECT doc_id, {distinct('(?:^|[^0-9])([0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})(?:[^0-9]|$)')} AS dates, {distinct(amount)} AS amounts, {distinct(legal.IDENTIFIER.replace('(?iu)', '(?i)'))} AS identifiers, {distinct(legal.UNIT.replace('(?iu)', '(?i)'))} AS units, nullif(regexp_extract(text, '{term}', 1), '')::INTEGER AS term_value, nullif(regexp_extract(text, '{term}', 2), '') AS term_unit, nullif(regexp_extract(text, '{term}', 3), '') AS term_start FROM d",
        "anchor_retention": S.sentences(S.SEEDED) + rf""", x AS (SELECT doc_id AS id, arg_min(text, paragraph_index * 1000000 + sentence_index) AS o, arg_max(text, paragraph_index * 1000000 + sentence_index) AS c FROM s GROUP BY doc_id),
y AS (SELECT id, {anchors('o')} AS a, {anchors('c')} AS b FROM x) SELECT id, len(a)::INTEGER AS anchors, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 4) ELSE 1 END::DOUBLE AS retention, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ',') AS lost FROM y""",
    }


def anchors(text: str) -> str:
    low = ", ".join(f"'{w}'" for w in features.LOW_SIGNAL)
    kept = rf"list_filter(regexp_extract_all(lower({text}), '\p{{L}}+'), lambda w: len(w) >= 5 AND w NOT IN ({low}) AND NOT regexp_matches(w, 'ow(?:ać|ić)$'))"
    return rf"list_distinct(list_transform({kept}, lambda w: regexp_replace(w, '{features.STEM}', '\1')))"


def twins() -> dict[str, str]:
    mine = "(SELECT *, lang AS model FROM documents WHERE lang <> 'en')"
    f = S.sentences(S.SEEDED) + f", x AS (SELECT doc_id, paragraph_index, sentence_index, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS l FROM s)"
    n = lambda spec, col="text": P.sql_count(col, spec)
    vague, nominal = f"len(list_filter(l, lambda x: regexp_matches(x, '{detect.VAGUE}')))", f"len(list_filter(l, lambda x: len(x) >= 7 AND regexp_matches(x, '{detect.NOMINAL}')))"
    left = P.sql_bare(f"regexp_replace({P.sql_marked('text')}, '{P.sql_pattern(features.PROHIBITION)}', ' ', 'g')")
    al = S.sentences(S.SEEDED) + S.found_cte() + S.SIGNAL
    date, amount = legal.DATE.replace(r"(?<!\d)", "").replace(r"(?!\d)", ""), legal.AMOUNT
    bad_case = r"([IVXLC]+)\s+([A-Z][A-Za-z]{0,4})\s+(\d{1,6})/(\d{4}|\d{2})"
    units = "(SELECT unnest([{'code': 'kc', 'article': '6'}, {'code': 'kc', 'article': '415'}, {'code': 'kpc', 'article': '187'}], recursive := true))"
    common = lambda source: f"SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM {source}) WHERE len(term) > 4 GROUP BY term ORDER BY n DESC, term LIMIT 20"
    listed = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL), ', ')"
    bad = listed(f"CASE WHEN contains(t, '{p}') THEN '{p}' END" for p in FORBIDDEN)
    old = listed(f"CASE WHEN contains(t, '{o}') AND NOT contains(t, '{p}') THEN '{o}' END" for o, p in PREFERRED.items())
    base = {
        "common_terms": common("documents"),
        "merged_entries": f"SELECT coalesce(o.term, f.term) AS term, coalesce(f.n, o.n)::DOUBLE AS z, CASE WHEN o.term IS NULL THEN 'candidate' ELSE 'rejected' END AS status, CASE WHEN o.term IS NULL THEN '' ELSE 'seen' END AS note FROM ({common('benchmark')}) o FULL JOIN ({common('documents')}) f ON o.term = f.term",
        "heading_support": headings() + r", hs AS (SELECT doc_id, line, lower(trim(regexp_replace(heading, '^(?:§\s*\d+[a-z]?\.?|[IVXLC]+\.|\d+(?:\.\d+)*[.)]?)\s*', ''))) AS heading FROM h), ha AS (SELECT heading, count(DISTINCT doc_id) AS k, quantile_cont(line, 0.5)::DOUBLE AS median_line FROM hs WHERE heading <> '' GROUP BY heading HAVING k >= 2) SELECT heading, round(k / (SELECT count(*) FROM d), 4) AS share, CASE WHEN k / (SELECT count(*) FROM d) >= 0.8 THEN 'required' ELSE 'expected' END AS severity, median_line FROM ha",
        "deontic_profile": f"WITH d AS ({S.SEEDED}) SELECT doc_id, {n(features.PROHIBITION)}::INTEGER AS prohibitions, {n(features.PERMISSION, left)}::INTEGER AS permissions, {n(features.OBLIGATION, left)}::INTEGER AS obligations FROM d",
        "style_compliance": f"WITH d AS ({S.SEEDED}), x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM d) SELECT doc_id, {bad} AS forbidden, {old} AS deprecated FROM x",
        "log_odds": f"WITH a AS ({terms('(SELECT * FROM documents WHERE lang = $$en$$)')}), b AS ({terms('(SELECT * FROM documents WHERE lang <> $$en$$)')}) " + log_odds(5),
        "model_support": f"WITH a AS ({terms('documents', 'source')}), b AS ({terms('benchmark')}) SELECT * FROM ({log_odds(1, 'source')}) WHERE log_odds > 0 AND count_a >= 2",
        "slop_candidates": f"""WITH m AS ({terms(mine, 'model')}), b AS ({terms("(SELECT * FROM documents WHERE lang = 'en')")}), pool AS (WITH a AS (SELECT term, sum(n)::BIGINT AS n FROM m GROUP BY term) {log_odds(5)}),
sup AS (WITH a AS (SELECT * FROM m) SELECT term, count(*) AS models FROM ({log_odds(1, 'model')}) WHERE log_odds > 0 AND count_a >= 2 GROUP BY term), sh AS (SELECT term, count(*) / (SELECT count(*) FROM {mine}) AS share FROM (SELECT unnest(list_distinct({TOK})) AS term FROM {mine}) GROUP BY term),
ho AS ({terms('benchmark')})
SELECT pool.term, z, models, round(share, 4) AS doc_share FROM pool JOIN sup USING (term) JOIN sh USING (term) LEFT JOIN ho USING (term) WHERE z >= 1.96 AND models >= 2 AND share >= 0.1
  AND (ho.n IS NULL OR (count_a / (SELECT sum(count_a) FROM pool)) / (ho.n / (SELECT sum(n) FROM ho)) >= 2)""",
        "detector_auc": r"WITH x AS (SELECT len(regexp_extract_all(coalesce(text, ''), '\p{L}+')) AS score, quality AS label FROM documents JOIN labels USING (doc_id)) SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 4) AS auc FROM x a, x b WHERE a.label = 1 AND b.label = 0",
        "usable_documents": r"SELECT doc_id, len(regexp_extract_all(text, '\p{L}+'))::INTEGER AS words FROM documents WHERE len(regexp_extract_all(text, '\p{L}+')) >= 150",
        "sentence_features": f + f""", y AS (SELECT doc_id, paragraph_index, sentence_index, len(l) AS words, len(regexp_extract_all(text, ',')) AS commas, {n(features.NEGATION)} AS negations, {n(features.TRANSITION)} AS transitions, {vague} AS vague, {nominal} AS nominalisations, len(regexp_extract_all(text, '{features.NUMBER}')) AS numbers,
  {n(features.PROHIBITION)} AS prohibitions, {n(features.PERMISSION, left)} AS permissions, {n(features.OBLIGATION, left)} AS obligations FROM x)
SELECT *, round(least(1.0, transitions * 0.18 + least(0.3, vague / greatest(words, 1)) + least(0.2, nominalisations / greatest(words, 1) * 2)), 4) AS artifact_score FROM y""",
        "paragraph_features": f + """, z AS (SELECT *, lag(l) OVER (PARTITION BY doc_id, paragraph_index ORDER BY sentence_index) AS pv FROM x), j AS (SELECT *, len(l) AS n, CASE WHEN pv IS NOT NULL AND len(list_distinct(list_concat(l, pv))) > 0 THEN len(list_intersect(list_distinct(l), list_distinct(pv))) / len(list_distinct(list_concat(l, pv))) END AS jc FROM z)
SELECT doc_id, paragraph_index, sum(n)::BIGINT AS words, round(avg(n), 4) AS mean_words, round(var_pop(n), 4) AS var_words, round(coalesce(avg(jc), 0), 4) AS topic_continuity FROM j GROUP BY ALL""",
        "sensitive_inventory": f"WITH d AS ({S.SEEDED}) SELECT doc_id, {', '.join(inventory(c) for c in features.INVENTORY)} FROM d",
        "learnt_numbering": learnt_numbering(),
        "headings": headings() + " SELECT * FROM h",
        "numbering_issues": headings() + r", v AS (SELECT doc_id, line, regexp_extract(heading, '^§\s*(\d{1,9})', 1)::BIGINT AS value FROM h WHERE regexp_matches(heading, '^§\s*\d')), g AS (SELECT *, lag(value) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM v) SELECT doc_id, line, value, b + 1 AS expected, CASE WHEN value <= b THEN 'repeat' ELSE 'gap' END AS issue FROM g WHERE value <> b + 1",
        "section_check": sections() + " SELECT * FROM sc",
        "section_bodies": section_bodies(),
        "order_issues": sections() + f""", q AS (SELECT *, list_position([{', '.join(f"'{x[0]}'" for x in structure.SECTIONS)}], section) AS rank FROM sc WHERE position IS NOT NULL), w AS (SELECT *, lead(rank) OVER o AS nr, lead(section) OVER o AS ns, lead(position) OVER o AS np FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY position, rank))
SELECT doc_id, arg_min(section, position) AS section, arg_min(ns, position) AS before FROM w WHERE nr < rank AND np > position GROUP BY doc_id""",
        "classify_family": family(), "classify_category": category(),
        "nearest_template": f"""WITH dp AS (SELECT doc_id, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS ps FROM (SELECT doc_id, {TOK} AS l FROM documents)), tp AS (SELECT item_id, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS ps FROM (SELECT item_id, {TOK} AS l FROM benchmark)),
k AS (SELECT doc_id, item_id, count(*) AS k, any_value(nd) AS nd, any_value(nt) AS nt FROM (SELECT doc_id, len(ps) AS nd, unnest(ps) AS pair FROM dp) JOIN (SELECT item_id, len(ps) AS nt, unnest(ps) AS pair FROM tp) USING (pair) GROUP BY ALL)
SELECT doc_id, item_id, f1, recall FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f1 DESC, item_id) AS r FROM (SELECT doc_id, item_id, round(2 * k / (nd + nt), 4) AS f1, round(k / nt, 4) AS recall FROM k WHERE k / nt >= 0.4)) WHERE r = 1""",
        "case_references": f"WITH d AS ({S.SEEDED}), y AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_]){bad_case}(?:$|[^0-9])')) AS m FROM d) SELECT DISTINCT doc_id, regexp_extract(m, '{bad_case}', 1) || ' ' || regexp_extract(m, '{bad_case}', 2) || ' ' || regexp_extract(m, '{bad_case}', 3) || '/' || right(regexp_extract(m, '{bad_case}', 4), 2) AS signature FROM y",
        "letter_parts": letter_parts(),
        "holidays": f"WITH {holidays('SELECT DISTINCT year(o_orderdate) AS year FROM orders')} SELECT year::INTEGER AS year, day FROM ho",
        "deadlines_days": deadlines("14"), "deadlines_months": deadlines("INTERVAL 1 MONTH"),
        "batch_summary": al + "SELECT count(*) AS documents, sum((findings > 0)::INTEGER)::BIGINT AS with_findings, sum(findings)::BIGINT AS findings, round(avg(signal_score), 4) AS mean_score, max(signal_score) AS max_score FROM ds",
        "resume_remaining": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "embedding_similarity": "WITH f AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings), c AS (SELECT label, k, avg(x::DOUBLE) AS m FROM f GROUP BY ALL) SELECT vec_id, any_value(label) AS label, round(sum(x::DOUBLE * m) / (sqrt(sum(x::DOUBLE * x::DOUBLE)) * sqrt(sum(m * m))), 4) AS similarity FROM f JOIN c USING (label, k) GROUP BY vec_id",
        "answer_signal": S.sentences("SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations WHERE role = 'assistant'") + S.found_cte() + S.SIGNAL + " SELECT * FROM ds",
    }
    return base | more(base)
