"""Queries that find places to sign, apply anchors and place signatures, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import patterns as pt
from ..functions import text as tx
from ..operators import clicks as ck
from ..operators import placement as pl
from ..operators import search as se
from ..sources.contracts import PRELUDE, contracts, lines, pages

#: The fixtures' party: an invalid pattern, a backward one, one in Cyrillic and one that repeats spans are among its patterns.
PARTY = se.Party(
    "Lessor", (r"Lessor: *_{3,}", r"[_\.]{5,} */Ivanov", r"_{3,}[\s\S]{0,60}Ivanov", "([", r"Подпись *_{3,}", r"Less(?:or|ee): _{5,} /", r"Lessor: _{3,}", r"No [0-9]+\nLessor: _{5,}"),
    ("Lessor", "Ivanov"), "Ivanov I.I.", ("Petrov", "Lessee", "XX"),
)
_pages = lambda spark, sf_dir: pages(contracts(spark, sf_dir))


# DuckDB spellings of the same rules.
def d_search(page_lines: str, needle: str, v: str) -> str:
    """Rectangles of a text on a page; ``v`` keeps the lambdas' names apart."""
    parts = f"string_split(lower({page_lines}[r{v}]), lower({needle}))"
    col = f"(coalesce(list_sum(list_transform({parts}[1:k{v}], lambda p{v}: len(p{v}))), 0) + (k{v} - 1) * len({needle}))"
    rect = f"{{'x0': 50::DOUBLE + 5 * {col}, 'y0': 50::DOUBLE + 20 * (r{v} - 1), 'x1': 50::DOUBLE + 5 * ({col} + len({needle})), 'y1': 62::DOUBLE + 20 * (r{v} - 1)}}"
    return f"(CASE WHEN len({needle}) > 0 THEN flatten(list_transform(range(1, len({page_lines}) + 1), lambda r{v}: list_transform(range(1, len({parts})), lambda k{v}: {rect}))) ELSE [] END)"


def d_distinct(words: str, v: str) -> str:
    return f"list_filter({words}, lambda w{v}, i{v}: list_position(list_transform({words}, lambda z{v}: lower(z{v})), lower(w{v})) = i{v})"


def d_words(text: str, v: str) -> str:
    return d_distinct(rf"list_filter(regexp_extract_all(regexp_replace({text}, '_{{2,}}', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'), lambda y{v}: len(y{v}) >= 3)", v)


def d_spans(text: str, pattern: str, v: str) -> str:
    """list of {start, matched}."""
    found, gaps = f"regexp_extract_all({text}, {pattern})", f"string_split_regex({text}, {pattern})"
    start = f"coalesce(list_sum(list_transform({gaps}[1:i{v}], lambda g{v}: len(g{v}))), 0) + coalesce(list_sum(list_transform({found}[1:i{v} - 1], lambda q{v}: len(q{v}))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i{v}: {{'start': CAST({start} AS BIGINT), 'matched': {found}[i{v}]}})"


def d_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{tx.WS}+|{tx.WS}+$', '', 'g')"


def d_rects(source: str, name: str, d_search=d_search) -> str:
    """CTEs that add ``rects`` (where ``matched`` stands on the page ``L``) to a table."""
    gap = "CASE WHEN u.x0 >= a.x1 THEN u.x0 - a.x1 WHEN u.x1 <= a.x0 THEN a.x0 - u.x1 ELSE 0 END"
    near = f"list_sort(list_transform(list_filter(range(1, len(us) + 1), lambda n: abs((us[n].y0 + us[n].y1) / 2 - (a.y0 + a.y1) / 2) <= 4), lambda n: {{'g': {gap.replace('u.', 'us[n].')}, 'n': n}}))[1].n"
    merged = "{'x0': least(a.x0, us[NN].x0), 'y0': least(a.y0, us[NN].y0), 'x1': greatest(a.x1, us[NN].x1), 'y1': greatest(a.y1, us[NN].y1)}".replace("NN", near)
    return f""",
{name}1 AS (SELECT *, {d_search("L", "matched", "e")} AS exact, {d_words("matched", "o")} AS words, {d_search("L", "'___'", "u")} AS us FROM {source}),
{name}2 AS (SELECT *, flatten(list_transform(words, lambda w: {d_search("L", "w", "f")})) AS ofw, {d_search("L", "coalesce(words[1], '')", "h")}[1:1] AS fst FROM {name}1),
{name}3 AS (SELECT *, list_transform(list_filter(ofw, lambda a: {near} IS NOT NULL), lambda a: {merged}) AS dup FROM {name}2),
{name}4 AS (SELECT *, list_filter(dup, lambda d, i: list_position(dup, d) = i) AS joined FROM {name}3),
{name} AS (
  SELECT *, CASE WHEN len(exact) > 0 THEN exact WHEN contains(matched, '__') AND len(words) = 0 THEN us[1:1]
    WHEN NOT contains(matched, '__') AND len(words) > 0 THEN fst
    WHEN len(words) > 0 THEN CASE WHEN len(ofw) = 0 THEN us[1:1] WHEN len(us) = 0 THEN ofw[1:1] WHEN len(joined) > 0 THEN joined ELSE fst END ELSE [] END AS rects
  FROM {name}4
)"""


PAGE_LINES = PRELUDE + """,
plines AS (SELECT doc_id, page_num, string_agg(line || chr(10), '' ORDER BY line_no) AS text, list(line ORDER BY line_no) AS L FROM lines GROUP BY doc_id, page_num)"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sig_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.spans(F.col("text"), r"[_\.]{3,}")
    rows = _pages(spark, sf_dir).select("doc_id", "page_num", F.explode(found).alias("s"))
    return rows.select("doc_id", "page_num", F.col("s.start").cast("long").alias("start"), F.length("s.matched").alias("size"), tx.signature_line(F.col("s.matched")).alias("is_line"))


SIG_SPANS = PAGE_LINES + f""", f AS (SELECT doc_id, page_num, unnest({d_spans("text", "'[_.]{3,}'", "a")}) AS s FROM plines)
SELECT doc_id, page_num::INTEGER AS page_num, s.start AS start, length(s.matched)::INTEGER AS size, regexp_matches(s.matched, '_{{3,}}|\\.{{5,}}') AS is_line FROM f"""

_CASES = ("'согласовано: руководитель отдела '", "'Lessor '", "'сотрудник один два три четыре '", "''")


def sig_role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.expr("case doc_id % 4 " + " ".join(f"when {i} then {c}" for i, c in enumerate(_CASES)) + " end")
    rows = contracts(spark, sf_dir).select("doc_id", before.alias("b"), F.concat(F.lit("Ivanov ____ Глава Petrov"), F.col("doc_id")).alias("m"))
    alias = lambda *t: F.array(*map(F.lit, t))
    return rows.select("doc_id", tx.in_role_phrase(F.col("b"), F.col("m"), alias("Ivanov")).alias("first_in_role"), tx.in_role_phrase(F.col("b"), F.col("m"), alias("Petrov", "none")).alias("second_in_role"))


def _d_role(tokens: str, v: str) -> str:
    roles = "[" + ", ".join(map(_sql, tx.ROLE_WORDS)) + "]"
    size = f"(coalesce(list_sum(list_transform(string_split(w, lower(t{v}))[1:k{v}], lambda p{v}: len(p{v}))), 0) + (k{v} - 1) * len(t{v}))::BIGINT"
    words = f"regexp_extract_all(right(left(w, {size}), 30), '[а-яёa-z]+')"
    return f"len(list_filter({tokens}, lambda t{v}: len(list_filter(range(1, len(string_split(w, lower(t{v})))), lambda k{v}: list_has_any({words}[-3:], {roles}))) > 0)) > 0"


SIG_ROLE_FILTER = f"""WITH c AS (SELECT doc_id, lower(CASE doc_id % 4 {' '.join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CASES))} END || ' ' || 'Ivanov ____ Глава Petrov' || doc_id) AS w FROM documents)
SELECT doc_id, {_d_role("['Ivanov']", "a")} AS first_in_role, {_d_role("['Petrov', 'none']", "b")} AS second_in_role FROM c"""



def d_candidates(patterns) -> str:
    """All matches of patterns (index, pattern, RE2's spelling)."""
    return " UNION ALL ".join(f"SELECT doc_id, page_num, text, L, {i} AS pattern_idx, {_sql(p)} AS pattern, unnest({d_spans('text', _sql('(?i)' + re2), 'c')}) AS s FROM plines WHERE regexp_matches(text, {_sql('(?i)' + re2)})" for i, p, re2 in patterns)


_cand = d_candidates([(i, p, p) for i, p in enumerate(PARTY.patterns) if se.admissible(p)])
_inter = "(least(k.x1, y[1].x1) - greatest(k.x0, y[1].x0))"
_inter_y = "(least(k.y1, y[1].y1) - greatest(k.y0, y[1].y0))"
_area = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
_ratio = f"CASE WHEN {_inter} > 0 AND {_inter_y} > 0 THEN {_inter} * {_inter_y} / least({_area.format('k')}, {_area.format('y[1]')}) ELSE 0 END"
def find_cte(pages: str = PAGE_LINES, d_search=d_search, candidates: str = _cand, others: tuple[str, ...] = ("petrov", "lessee")) -> str:
    """Places to sign of the fixtures' party on pages (``plines``: doc_id, page_num, text, layout ``L``), by a layout's search."""
    return pages + f""",
cand0 AS ({candidates}),
cand1 AS (SELECT *, s.start AS start, s.matched AS matched FROM cand0 WHERE regexp_matches(s.matched, '_{{3,}}|\\.{{5,}}')),
cand2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, start, len(matched) ORDER BY pattern_idx) AS rn FROM cand1),
cand AS (SELECT * FROM cand2 WHERE rn = 1{"".join(f" AND NOT contains(lower(matched), '{o}')" for o in others)})
""" + d_rects("cand", "rc", d_search) + f""",
boxes AS (SELECT *, rects[i] AS r, list_concat(us, {d_search("L", "'.....'", "v")}) AS ln FROM (SELECT *, unnest(range(1, len(rects) + 1)) AS i FROM rc)),
hit AS (SELECT * FROM boxes WHERE len(list_filter(ln, lambda u: u.y0 <= r.y1 AND u.y1 >= r.y0 AND u.x0 <= r.x1 AND u.x1 >= r.x0)) > 0),
raw AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, pattern_idx, start, i) AS seq FROM hit),
grouped AS (SELECT doc_id, page_num, list({{'seq': seq, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}} ORDER BY seq) AS m FROM raw GROUP BY doc_id, page_num),
nms AS (SELECT *, list_reduce(list_transform(m, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: {_ratio} > 0.7)) > 0 THEN acc ELSE list_concat(acc, y) END) AS kept FROM grouped),
sorted AS (SELECT *, list_transform(list_sort(list_transform(kept, lambda x: {{'a': {_area.format('x')}, 'seq': x.seq, 'c': x}})), lambda z: z.c) AS by_area FROM nms),
one AS (SELECT *, list_reduce(list_transform(by_area, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda k: abs((k.y0 + k.y1) / 2 - (y[1].y0 + y[1].y1) / 2) <= 6 AND least(k.x1, y[1].x1) > greatest(k.x0, y[1].x0))) > 0 THEN acc ELSE list_concat(acc, y) END) AS final FROM sorted)"""


FIND_CTE = find_cte()


def _matches(spark, sf_dir, column):
    rows = se.raw_matches(_pages(spark, sf_dir), PARTY)
    if column != "raw":
        rows = rows.withColumn("kept", geo.without_overlaps(F.col("raw")))
    if column == "final":
        rows = rows.withColumn("final", geo.one_per_row(F.col("kept")))
    return se.listed(rows, column, PARTY).select("doc_id", "match_id", "page_num", "x0", "y0", "x1", "y1")


def _listed_sql(cte: str, column: str) -> str:
    return FIND_CTE + f""", f AS (SELECT doc_id, page_num, unnest({column}) AS c FROM {cte})
SELECT doc_id, 'sig_' || lpad(c.seq::VARCHAR, greatest(3, len(c.seq::VARCHAR))::INTEGER, '0') AS match_id, page_num::INTEGER AS page_num, c.x0 AS x0, c.y0 AS y0, c.x1 AS x1, c.y1 AS y1 FROM f"""


def sig_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "raw")


def sig_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "kept")


def sig_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, "final")


def find_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.find_signatures(_pages(spark, sf_dir), PARTY)


_CONTEXT = d_strip("replace(substr(text, (greatest(0, start - 40) + 1)::BIGINT, (start + len(matched) + 40 - greatest(0, start - 40))::BIGINT), chr(10), ' ')")
def find_sql(cte: str = FIND_CTE) -> str:
    return cte + f""", f AS (SELECT doc_id, unnest(final) AS c FROM one)
SELECT raw.doc_id, 'sig_' || lpad(raw.seq::VARCHAR, greatest(3, len(raw.seq::VARCHAR))::INTEGER, '0') AS match_id, page_num::INTEGER AS page_num, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1, {_CONTEXT} AS context, pattern
FROM raw JOIN f ON raw.doc_id = f.doc_id AND raw.seq = f.c.seq"""


FIND_SIGNATURES = find_sql()


def find_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No regular pattern fits two of three documents; those are searched again with the fallback's patterns."""
    party = se.Party("Lessor", (r"Annex No 1\nLessor: _{5,}",), PARTY.aliases, PARTY.signer, PARTY.other_aliases)
    out = se.find_signatures_smart(_pages(spark, sf_dir), party, PARTY.patterns)
    return out.groupBy("doc_id", "mode").agg(F.count("*").alias("n"))


FIND_SMART = FIND_CTE + """, a AS (SELECT DISTINCT doc_id FROM plines WHERE regexp_matches(text, 'Annex No 1\\nLessor: _{5,}')), n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(final) AS c FROM one) GROUP BY doc_id)
SELECT n.doc_id, CASE WHEN a.doc_id IS NULL THEN 'llm_fallback' ELSE 'regex' END AS mode, CASE WHEN a.doc_id IS NULL THEN n ELSE 1 END AS n FROM n LEFT JOIN a ON n.doc_id = a.doc_id"""

#: Anchors of the fixtures' template: pattern, hint, context before, text.
ANCHORS = (
    (r"Lessor: *[_\.]{5,}", "last", "", "Lessor line"), (r"Nothing_{9}X", "first", "", "Never there"), (r"[_\.]{5,} */Petrov", "any", "Lessee:", "Petrov line"),
    (r"Lessee: *_{3,}", "-1", "no such context", "Lessee line"), (r"Section [0-9]", "99", "", "Far page"), (r"Annex No [0-9]+", "any", "Payment", "Annex"), (None, "1", "", "By its box"),
)


def anchor_table(rows: DataFrame) -> DataFrame:
    """The fixtures' anchors for each row of a table of keys."""
    fields = lambda i, a: f"struct({i} as anchor_idx, {'cast(null as string)' if a[0] is None else tx.quoted(a[0])} as pattern, {tx.quoted(a[1])} as page_hint, {tx.quoted(a[2])} as context_before, {tx.quoted(a[3])} as anchor_text)"
    anchors = rows.select("*", F.explode(F.expr("array(" + ", ".join(fields(i, a) for i, a in enumerate(ANCHORS)) + ")")).alias("a")).select(*rows.columns, "a.*")
    box = F.struct(F.lit(10.0).alias("x0"), (F.col("anchor_idx") * 10.0).alias("y0"), F.lit(110.0).alias("x1"), (F.col("anchor_idx") * 10.0 + 12.0).alias("y1"))
    return anchors.withColumn("bbox", box)


def apply_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts(spark, sf_dir)
    return se.apply_anchors(pages(docs), anchor_table(docs.select("doc_id")))


_anchor_rows = ", ".join(f"({i}, {'NULL' if a[0] is None else _sql(a[0])}, {_sql(a[1])}, {_sql(a[2])}, {_sql(a[3])})" for i, a in enumerate(ANCHORS))
_anchor_spans = " UNION ALL ".join(f"SELECT *, unnest({d_spans('text', _sql('(?i)' + a[0]), 'c')}) AS s FROM onpage WHERE anchor_idx = {i}" for i, a in enumerate(ANCHORS) if a[0])


def apply_sql(pages: str = PAGE_LINES, d_search=d_search) -> str:
    return pages + f""",
anchors(anchor_idx, pattern, page_hint, context_before, anchor_text) AS (VALUES {_anchor_rows}),
n AS (SELECT doc_id, count(*) AS n FROM plines GROUP BY doc_id),
asked AS (
  SELECT *, CASE WHEN page_hint = 'first' THEN [0] WHEN page_hint = 'last' THEN [n - 1] WHEN page_hint = 'any' THEN range(0, n) WHEN try_cast(page_hint AS INTEGER) IS NOT NULL THEN [try_cast(page_hint AS INTEGER)] ELSE range(0, n) END AS hinted FROM n, anchors
),
spread AS (SELECT *, hinted[o] AS page FROM (SELECT *, unnest(range(1, len(hinted) + 1)) AS o FROM asked)),
onpage AS (SELECT a.*, p.text, p.L FROM spread a JOIN plines p ON a.doc_id = p.doc_id AND p.page_num = CASE WHEN page < 0 THEN n + page ELSE page END),
found AS (SELECT *, s.start AS start, s.matched AS matched FROM ({_anchor_spans})),
fit AS (
  SELECT * FROM found WHERE context_before = '' OR contains(lower(regexp_replace(substr(text, (greatest(0, start - len(context_before) - 40) + 1)::BIGINT, least(start, len(context_before) + 40)::BIGINT), '{tx.WS}+', ' ', 'g')), lower(context_before))
)""" + d_rects("fit", "fr", d_search) + f""",
hits AS (SELECT doc_id, anchor_idx, o, start, i, page, rects[i] AS r, {_CONTEXT} AS context, pattern FROM (SELECT *, unnest(range(1, len(rects) + 1)) AS i FROM fr)),
missed AS (
  SELECT doc_id, anchor_idx, 1 AS o, 0 AS start, 1 AS i, hinted[1] AS page, {{'x0': 10::DOUBLE, 'y0': anchor_idx * 10::DOUBLE, 'x1': 110::DOUBLE, 'y1': anchor_idx * 10::DOUBLE + 12}} AS r, anchor_text AS context, '[bbox_fallback] ' || coalesce(pattern, '') AS pattern
  FROM asked ANTI JOIN hits USING (doc_id, anchor_idx) WHERE hinted[1] BETWEEN 0 AND n - 1
),
every AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY anchor_idx, o, start, i) AS k FROM (SELECT * FROM hits UNION ALL SELECT * FROM missed))
SELECT doc_id, 'tpl_' || lpad(k::VARCHAR, greatest(3, len(k::VARCHAR))::INTEGER, '0') AS match_id, page::INTEGER AS page_num, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1, context, pattern FROM every"""


APPLY_TEMPLATE = apply_sql()


def match_to_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.matches_to_anchors(se.find_signatures(_pages(spark, sf_dir), PARTY))


_by_pattern = lambda what: "CASE pattern " + " ".join(f"WHEN {_sql(p)} THEN {what.format(_sql('(?i)' + p))}" for p in PARTY.patterns if se.admissible(p)) + " END"
MATCH_TO_ANCHOR = f"""WITH found AS ({FIND_SIGNATURES}),
cut AS (SELECT *, {_by_pattern("regexp_extract(context, {0})")} AS hit FROM found),
p AS (SELECT *, hit <> '' AS ok, instr(context, hit) AS pos FROM cut)
SELECT doc_id, match_id, substr({d_strip("context")}, 1, 120) AS anchor_text, pattern AS generated_pattern, CASE WHEN ok THEN right(substr(context, 1, pos - 1), 50) ELSE '' END AS context_before,
  CASE WHEN ok THEN substr(substr(context, pos + len(hit)), 1, 50) ELSE '' END AS context_after, page_num::VARCHAR AS page_hint, 'auto_regex' AS added_by, x0, y0, x1, y1 FROM p"""


#: Patterns that Java reads otherwise than Python, or not at all, each with RE2's spelling for the oracle (None: it cannot run and is skipped).
FORMS = (
    (r"Lessor {name} _{3,}", r"Lessor \{name\} _{3,}"), (r"[[]?_{3,}", r"\[?_{3,}"), (r"_{,9}_{3,}", r"_{0,9}_{3,}"), (r"(?P<x>_)(?P=x){3,}", r"_{4,}"), (r"Annex No {1}\d", r"Annex No {1}[0-9]"), (r"No{,1} [0-9]", r"No{0,1} [0-9]"),
    (r"[]/]Ivanov", r"[\]/]Ivanov"), (r"[a&&b]nnex", r"[a&b]nnex"), (r"[l-m[]essor", r"[l-m\[]essor"), (r"\bPayment\b", r"\bPayment\b"), (r"Lessor\Z", None), (r"(?P<w>s)(?P=w)or", "ssor"), (r"(?s:Payment.Annex)", r"Payment\nAnnex"),
    (r"(?m)^Lessor:", r"(?m)^Lessor:"), (r"(?m)[0-9]$", r"(?m)[0-9]$"), (r"(?>_+) /", "_+ /"), (r"_++ /P", "_+ /P"), (r"(?#note)Lessee", "Lessee"), ("(?x) Les see  # comment", "Lessee"), (r"\x4cessee:\s_", r"Lessee:\s_"), (r"[\d-]+ LLC", r"[0-9-]+ LLC"),
    (r"(?-i:lessor)", None), (r"(?i:LESSOR):", "Lessor:"), (r"\u004cessor", "Lessor"), (r"\N{LATIN CAPITAL LETTER L}essee", "Lessee"), (r"Les{2}(?:or|ee): __", r"Les{2}(?:or|ee): __"), (r"(?:_{2}){2}", "(?:_{2}){2}"), (r"\.\sPayment", r"\.\sPayment"),
    (r"Section \d(?=\.)", r"Section [0-9]"), (r"(?<=Section )\d", None), (r"(a)?(?(1)b|c)", None), (r"(", None), (r"\p{L}", None), (r"(a)(?<=\1)b", None), (r"{Lessor}", r"\{Lessor\}"), (r"Firm[0-9] LLC", r"Firm[0-9] LLC"),
)


def translated_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each form in each document, and the sum of where they start on their pages; those without an oracle's spelling must only end nothing."""
    known = [(i, java) for i, (p, re2) in enumerate(FORMS) if (java := pt.compiled(spark, p)) and re2 is not None]
    rows = _pages(spark, sf_dir).select("doc_id", F.explode(se.pattern_spans(F.col("text"), known)).alias("s"))
    return rows.groupBy("doc_id", F.col("s.pattern_idx").alias("pattern_idx")).agg(F.count("*").alias("n"), F.sum("s.start").cast("long").alias("starts"), F.sum(F.length("s.matched")).cast("long").alias("sizes"))


_forms = " UNION ALL ".join(f"SELECT doc_id, {i} AS pattern_idx, unnest({d_spans('text', _sql('(?i)' + re2), 'c')}) AS s FROM plines" for i, (_, re2) in enumerate(FORMS) if re2 is not None)
TRANSLATED_PATTERNS = PAGE_LINES + f""", f AS ({_forms})
SELECT doc_id, pattern_idx, count(*) AS n, CAST(sum(s.start) AS BIGINT) AS starts, CAST(sum(len(s.matched)) AS BIGINT) AS sizes FROM f GROUP BY doc_id, pattern_idx"""

#: A party whose patterns and the model's replies hold such forms beside ordinary ones.
ODD = se.Party("Lessee", (r"Lessor {name} _{3,}", r"(a)?(?(1)b|c)", r"(?P<l>Less)ee:[ ]_{,9}_{3,}", r"\p{L}_{3,}", r"(?m)^Lessee: (?P<x>_)(?P=x){3,}", r"Lessee: [[]?_{3,}"), ("Lessee",), "Petrov P.P.", ("Ivanov", "Lessor"))


def odd_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.find_signatures(_pages(spark, sf_dir), ODD)


ODD_FORMS = {2: r"Lessee:[ ]_{0,9}_{3,}", 4: r"(?m)^Lessee: _{4,}", 5: r"Lessee: \[?_{3,}"}

ODD_SIGNATURES = find_sql(find_cte(candidates=d_candidates([(i, ODD.patterns[i], re2) for i, re2 in ODD_FORMS.items()]), others=("ivanov", "lessor")))


def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = se.count_patterns(_pages(spark, sf_dir), PARTY.patterns)
    return rows.groupBy("doc_id").agg(F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("total"), F.max(F.col("n") > 0).alias("any"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pattern_idx", "n"))), lambda x: x["n"].cast("string")), ",").alias("by_pattern"))


_counts = [f"CAST(sum(len(regexp_extract_all(text, {_sql('(?i)' + p)}))) AS BIGINT)" if pt.valid(p) else "-1" for p in PARTY.patterns]
PATTERN_COUNTS = PRELUDE + f""", c AS (SELECT doc_id, [{", ".join(_counts)}] AS c FROM cpages GROUP BY doc_id)
SELECT doc_id, CAST(list_sum(list_filter(c, lambda x: x > 0)) AS BIGINT) AS total, len(list_filter(c, lambda x: x > 0)) > 0 AS "any", array_to_string(c, ',') AS by_pattern FROM c"""


def _clicks(docs):
    title = F.length(F.concat(F.lit("LEASE AGREEMENT No "), F.col("doc_id"))) * 2.5 + 50.0
    kinds = F.expr("array(struct(0 as kind, 0 as page_num), struct(1 as kind, 0 as page_num), struct(2 as kind, 0 as page_num), struct(3 as kind, 99999 as page_num), struct(4 as kind, 0 as page_num), struct(5 as kind, 1 as page_num))")
    rows = docs.select("doc_id", title.alias("c"), F.explode(kinds).alias("k"))
    kind = F.col("k.kind")
    x = F.when(kind == 0, F.col("c") + F.col("doc_id") % 9 * 4.0 - 16.0).when(kind == 1, 590.0).when(kind == 2, 120.0).when(kind == 4, 30000.0).otherwise(60.0)
    y = F.when(kind == 0, F.lit(58.0) + F.col("doc_id") % 3 * 8.0).when(kind == 1, 60.0).when(kind == 2, 200.0).when(kind == 4, 3000.0).otherwise(30.0)
    return rows.select((F.col("doc_id") * 10 + kind).alias("click_id"), "doc_id", F.col("k.page_num").alias("page_num"), x.alias("x"), y.alias("y"))


def click_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts(spark, sf_dir)
    return ck.anchors_from_clicks(_clicks(docs), ck.blocks(lines(docs)), pages(docs))


CLICK_CTE = PRELUDE + """,
clicks AS (
  SELECT doc_id * 10 + kind AS click_id, doc_id, CASE kind WHEN 3 THEN 99999 WHEN 5 THEN 1 ELSE 0 END AS page_num,
    CAST(CASE kind WHEN 0 THEN length('LEASE AGREEMENT No ' || doc_id) * 2.5 + 50 + doc_id % 9 * 4 - 16 WHEN 1 THEN 590 WHEN 2 THEN 120 WHEN 4 THEN 30000 ELSE 60 END AS DOUBLE) AS x,
    CAST(CASE kind WHEN 0 THEN 58 + doc_id % 3 * 8 WHEN 1 THEN 60 WHEN 2 THEN 200 WHEN 4 THEN 3000 ELSE 30 END AS DOUBLE) AS y
  FROM (SELECT doc_id, unnest(range(6)) AS kind FROM contracts)
),
blocks AS (SELECT doc_id, page_num, line_in_page AS block_no, line AS text, 50::DOUBLE AS x0, 50::DOUBLE + 20 * line_in_page AS y0, 50::DOUBLE + 5 * length(line) AS x1, 62::DOUBLE + 20 * line_in_page AS y1 FROM lines),
near AS (SELECT k.*, b.* EXCLUDE (doc_id, page_num), sqrt((x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2)) AS dist, """ + d_strip("text") + """ AS bare FROM clicks k JOIN blocks b USING (doc_id, page_num)),
lev AS (
  SELECT *, regexp_matches(text, '[_.]{5,}') AND dist < 51 AS under,
    CASE WHEN bare <> '' AND dist <= 30 THEN 1 WHEN bare <> '' AND abs(y - (y0 + y1) / 2) <= 10 THEN 2 WHEN bare <> '' AND dist <= 200 THEN 3 WHEN regexp_matches(text, '[_.]{5,}') AND dist < 51 THEN 4 END AS level FROM near
)"""
CLICK_ANCHOR = CLICK_CTE + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY level, dist, block_no) AS rn FROM lev WHERE level IS NOT NULL) WHERE rn = 1),
n AS (SELECT doc_id, count(DISTINCT page_num) AS n FROM lines GROUP BY doc_id),
pos AS (
  SELECT b.*, n.n, p.text AS page_text, substr(bare, 1, 120) AS anchor_text, x - (x0 + x1) / 2 AS dx, y - (y0 + y1) / 2 AS dy
  FROM best b JOIN n ON b.doc_id = n.doc_id JOIN cpages p ON b.doc_id = p.doc_id AND b.page_num = p.page_num
),
wh AS (
  SELECT *, CASE WHEN abs(dy) <= 15 THEN CASE WHEN dx > 5 THEN 'right' WHEN dx < -5 THEN 'left' ELSE 'on' END WHEN dy > 0 THEN 'below' ELSE 'above' END AS position,
    CASE WHEN abs(dy) <= 15 THEN CASE WHEN abs(dx) > 5 THEN abs(dx) ELSE 0 END ELSE abs(dy) END AS offset_pt,
    regexp_replace(substr(anchor_text, 1, 60), '([^\\p{L}\\p{N}_])', '\\\\\\1', 'g') AS esc, least(150, greatest(80, (x1 - x0) * 1.2::DOUBLE)) AS w, least(15, greatest(8, y1 - y0)) AS h, instr(page_text, bare) AS pos
  FROM pos
)
SELECT c.click_id, level::INTEGER AS anchor_level, CASE WHEN level = 4 THEN 'underline_line' WHEN level IS NOT NULL THEN 'text_proximity' END AS anchor_type, anchor_text, position, offset_pt,
  CASE WHEN level = 4 THEN '[_\\.]{5,}' WHEN position IN ('right', 'on') THEN esc || '\\s*[_\\.]{5,}' WHEN position = 'left' THEN '[_\\.]{5,}\\s*' || esc WHEN position = 'below' THEN esc || '[\\s\\S]{0,60}[_\\.]{5,}' WHEN position = 'above' THEN '[_\\.]{5,}[\\s\\S]{0,60}' || esc END AS generated_pattern,
  CASE WHEN pos > 0 THEN replace(substr(page_text, greatest(1, pos - 50), least(pos - 1, 50)), chr(10), ' ') WHEN level IS NOT NULL THEN '' END AS context_before,
  CASE WHEN pos > 0 THEN replace(substr(page_text, pos + length(bare), 50), chr(10), ' ') WHEN level IS NOT NULL THEN '' END AS context_after,
  CASE WHEN level IS NOT NULL THEN CASE WHEN wh.page_num = 0 THEN 'first' WHEN wh.page_num = n - 1 THEN 'last' ELSE wh.page_num::VARCHAR END END AS page_hint,
  CASE position WHEN 'right' THEN x1 + offset_pt WHEN 'left' THEN x0 - offset_pt - w ELSE x0 END AS x0, CASE position WHEN 'below' THEN y1 + offset_pt WHEN 'above' THEN y0 - offset_pt - h ELSE y0 END AS y0,
  CASE position WHEN 'right' THEN x1 + offset_pt + w WHEN 'left' THEN x0 - offset_pt ELSE x0 + w END AS x1, CASE position WHEN 'below' THEN y1 + offset_pt + h WHEN 'above' THEN y0 - offset_pt ELSE y0 + h END AS y1
FROM clicks c LEFT JOIN wh ON c.click_id = wh.click_id"""


def has_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts(spark, sf_dir)
    return ck.has_anchor(_clicks(docs), ck.blocks(lines(docs)))


HAS_ANCHOR = CLICK_CTE + " SELECT c.click_id, coalesce(bool_or(level = 1 OR under), false) AS has_anchor FROM clicks c LEFT JOIN lev ON c.click_id = lev.click_id GROUP BY c.click_id"

_HINTS = "CASE doc_id % 8 WHEN 0 THEN 'first' WHEN 1 THEN 'last' WHEN 2 THEN 'any' WHEN 3 THEN '2' WHEN 4 THEN '-1' WHEN 5 THEN '999' WHEN 6 THEN 'x1' ELSE '' END"


def page_hint_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts(spark, sf_dir)
    n = pages(docs).groupBy("doc_id").agg(F.count("*").cast("int").alias("n")).withColumn("hint", F.expr(_HINTS))
    listed = F.array_join(F.transform(se.hinted_pages(F.col("hint"), F.col("n")), lambda p: p.cast("string")), ",")
    return n.select("doc_id", listed.alias("template_pages"), se.signing_page(F.col("hint")).alias("signing_page"), se.page_hint((F.col("doc_id") % F.col("n")).cast("int"), F.col("n")).alias("encoded"))


PAGE_HINT_DECODE = PRELUDE + f""", h AS (SELECT doc_id, count(*) AS n, {_HINTS} AS hint FROM cpages GROUP BY doc_id)
SELECT doc_id, array_to_string(CASE WHEN hint = 'first' THEN [0] WHEN hint = 'last' THEN [n - 1] WHEN hint = 'any' THEN range(0, n) WHEN try_cast(hint AS INTEGER) IS NOT NULL THEN [try_cast(hint AS INTEGER)] ELSE range(0, n) END, ',') AS template_pages,
  CASE WHEN hint = 'first' THEN 0 WHEN hint = 'last' THEN -1 ELSE coalesce(try_cast(hint AS INTEGER), 0) END AS signing_page, CASE WHEN doc_id % n = 0 THEN 'first' WHEN doc_id % n = n - 1 THEN 'last' ELSE (doc_id % n)::VARCHAR END AS encoded FROM h"""


def _reviewed(found):
    return found.withColumn("status", F.when(F.col("doc_id") % 5 == 0, "rejected_by_llm").otherwise("candidate")).withColumn("operator_excluded", F.col("doc_id") % 7 == 0)


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir)
    return pl.placements(_reviewed(se.find_signatures(rows, PARTY)), rows, pl.Options(scale=1.5, aspect=2.5, marker_color="gray"))


def placements_sql(pages: str = PAGE_LINES, d_search=d_search) -> str:
    return f"""WITH found AS ({find_sql(find_cte(pages, d_search))}),
pg AS (SELECT doc_id, page_num, L FROM ({pages} SELECT * FROM plines)),
k AS (SELECT f.*, {d_search("L", "'___'", "z")} AS us FROM found f JOIN pg ON f.doc_id = pg.doc_id AND f.page_num = pg.page_num WHERE f.doc_id % 5 <> 0 AND f.doc_id % 7 <> 0),
b AS (SELECT *, us[list_sort(list_transform(list_filter(range(1, len(us) + 1), lambda n: us[n].y1 >= y0 - 2 AND us[n].y0 <= y1 + 2 AND us[n].x0 >= x0 - 10 AND us[n].x0 <= x1), lambda n: {{'d': abs((us[n].y0 + us[n].y1) / 2 - (y0 + y1) / 2), 'n': n}}))[1].n] AS u, pattern LIKE '\\_%' ESCAPE '\\' AS on_line FROM k),
p AS (SELECT *, CASE WHEN on_line THEN x0 + 20 WHEN u IS NOT NULL THEN u.x0 + 20 ELSE x0 + (x1 - x0) * 0.3::DOUBLE END AS px, CASE WHEN NOT on_line AND u IS NOT NULL THEN u.y1 ELSE y1 END AS py FROM b)
SELECT doc_id, match_id, page_num, px AS sig_x0, py - 63 AS sig_y0, px + 157.5::DOUBLE AS sig_x1, py AS sig_y1, 581::DOUBLE AS mark_x0, (y0 + y1) / 2 - 17 AS mark_y0, 592::DOUBLE AS mark_x1, (y0 + y1) / 2 + 17 AS mark_y1, 'gray' AS mark_color FROM p"""


PLACEMENTS = placements_sql()


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.highlights(_reviewed(se.find_signatures(_pages(spark, sf_dir), PARTY)))


HIGHLIGHTS = f"WITH found AS ({FIND_SIGNATURES}) SELECT doc_id, match_id, page_num, x0 * 1.5::DOUBLE AS x0, y0 * 1.5::DOUBLE AS y0, x1 * 1.5::DOUBLE AS x1, y1 * 1.5::DOUBLE AS y1, CASE WHEN doc_id % 7 = 0 THEN 'gray' ELSE 'red' END AS color FROM found"

QUERIES = {f.__name__: f for f in (sig_spans, sig_role_filter, sig_rects, sig_nms, sig_rows, find_signatures, find_smart, apply_template, match_to_anchor, translated_patterns, odd_signatures, pattern_counts, click_anchor, has_anchor, page_hint_decode, placements, highlights)}
SQL = {
    "sig_spans": SIG_SPANS, "sig_role_filter": SIG_ROLE_FILTER, "sig_rects": _listed_sql("grouped", "m"), "sig_nms": _listed_sql("nms", "kept"), "sig_rows": _listed_sql("one", "final"), "find_signatures": FIND_SIGNATURES,
    "find_smart": FIND_SMART, "apply_template": APPLY_TEMPLATE, "match_to_anchor": MATCH_TO_ANCHOR, "translated_patterns": TRANSLATED_PATTERNS, "odd_signatures": ODD_SIGNATURES, "pattern_counts": PATTERN_COUNTS, "click_anchor": CLICK_ANCHOR, "has_anchor": HAS_ANCHOR, "page_hint_decode": PAGE_HINT_DECODE,
    "placements": PLACEMENTS, "highlights": HIGHLIGHTS,
}
