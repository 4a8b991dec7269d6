"""Queries over the automatic flow and what surrounds it, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import engine
from ..operators import auto
from ..operators import fingerprint as fp
from ..operators import matcher
from ..operators import patterns as pt
from ..operators import prompts as pr
from ..operators import registry as rg
from ..operators import search as se
from ..sources.contracts import PRELUDE, contracts, lines, pages, table
from . import matching, searching
from .language import _case
from .searching import PAGE_LINES, _sql, d_search, d_spans, d_words

SIDE = '{"our_side_index": 1, "confidence": 0.8, "our_side_synonyms": {"legal_entity": "Firm LLC", "roles": ["Lessor"], "signer": "Ivanov I.I."}, "all_parties": [{"legal_entity": "Petrov Trade", "role": "Lessee", "signer": "Petrov"}]}'
STEP3 = (SIDE, SIDE, SIDE, "no", '{"our_side_index": null}', SIDE)
STEP4 = ('{"patterns": ["Lessor: *_{3,}", {"pattern": "(["}, "Lessee: *_{3,}"]}', "none", '{"patterns": ["([", ""]}', None, None, '{"patterns": ["Nothing_{9,}"]}')


def _replies(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_case(STEP3, "spark")).alias("a"), F.expr(_case(STEP4, "spark")).alias("b"))
    return rows.select("doc_id", F.expr("stack(2, 'step3', a, 'step4', b) as (step, raw)"))


def auto_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = auto.sides(_replies(spark, sf_dir))
    return auto.results(found, auto.matches(pages(contracts(spark, sf_dir)), found))


_E = auto.ERRORS
_RAW = f"SELECT doc_id, {_case(STEP3, 'duck')} AS a, {_case(STEP4, 'duck')} AS b FROM documents"
#: Computed from the replies and the pages: our side, the patterns that compile, their matches without the other party's names.
AUTO_CTE = PAGE_LINES + f""",
j AS (SELECT doc_id, try_cast(a AS JSON) AS a, try_cast(b AS JSON) AS b FROM ({_RAW})),
side AS (
  SELECT doc_id, b, CASE WHEN a IS NULL OR json_type(a) <> 'OBJECT' THEN '{_E["no JSON"]}' WHEN a->>'our_side_index' IS NULL OR coalesce((a->>'confidence')::DOUBLE, 0) < 0.5 THEN '{_E["side not found"]}' END AS e3,
    a->>'$.our_side_synonyms.legal_entity' AS entity, CAST(a->'$.our_side_synonyms.roles' AS VARCHAR[]) AS roles,
    CAST(a->'$.all_parties' AS STRUCT(legal_entity VARCHAR, role VARCHAR, signer VARCHAR)[]) AS parties
  FROM j
),
items AS (SELECT doc_id, unnest(CAST(b->'$.patterns' AS JSON[])) AS v, generate_subscripts(CAST(b->'$.patterns' AS JSON[]), 1) AS i FROM side WHERE json_type(b) = 'OBJECT'),
texts AS (SELECT doc_id, i, CASE json_type(v) WHEN 'OBJECT' THEN v->>'pattern' ELSE v->>'$' END AS p FROM items),
valid AS (SELECT doc_id, i, p FROM texts WHERE trim(p) <> '' AND TRY(regexp_matches('', p)) IS NOT NULL),
others AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(parties, lambda x: list_concat([x.role], string_split(x.legal_entity, ' '), string_split(x.signer, ' ')))), lambda w: lower(w)), lambda w: len(w) >= 3 AND NOT list_contains(list_transform(roles, lambda r: lower(r)), w)) AS words FROM side),
spans AS (SELECT q.doc_id, q.page_num, unnest({d_spans("text", "'(?i)' || p", "au")}) AS s FROM plines q JOIN valid USING (doc_id) WHERE regexp_matches(text, '(?i)' || p)),
places AS (SELECT DISTINCT s1.doc_id, page_num, s.start AS start FROM spans s1 JOIN others USING (doc_id) WHERE regexp_matches(s.matched, '_{{3,}}|\\.{{5,}}') AND len(list_filter(words, lambda w: contains(lower(s.matched), w))) = 0),
flow AS (
  SELECT side.doc_id, side.entity, coalesce(n, 0) AS n, coalesce(np, 0) AS np,
    coalesce(e3, CASE WHEN b IS NULL OR json_type(b) <> 'OBJECT' THEN '{_E["no patterns"]}' WHEN np IS NULL THEN '{_E["none valid"]}' END) AS e4
  FROM side LEFT JOIN (SELECT doc_id, count(*) AS np FROM valid GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id) USING (doc_id)
),
auto AS (SELECT doc_id, entity, coalesce(e4, CASE WHEN n = 0 THEN '{_E["none found"]}' END) AS error, CASE WHEN e4 IS NULL THEN np END::INTEGER AS n_patterns, CASE WHEN e4 IS NULL THEN n ELSE 0 END::BIGINT AS n_matches FROM flow)"""
AUTO_PIPELINE = AUTO_CTE + " SELECT doc_id, error IS NULL AS ok, error, n_patterns, n_matches FROM auto"


def _analysis(spark: SparkSession, sf_dir: str) -> engine.Analysis:
    """All contracts (those that became templates find themselves) against the registry whose templates all have the fixtures' anchors."""
    docs, replies = contracts(spark, sf_dir), _replies(spark, sf_dir)
    templates = matching.registry(matching.prints(spark, sf_dir))
    ours = matching.same_side()
    fixed = searching.anchor_table(templates.select("template_id"))
    return engine.analyze(docs, pages(docs), lines(docs), templates, fixed, lambda ids: replies.join(ids, "doc_id", "left_semi"), synonyms_match=ours)


def analyze_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the documents that got their template's anchors."""
    a = _analysis(spark, sf_dir)
    return a.results.where("path = 'template'").select("doc_id", "template_id").join(a.matches, "doc_id")


_ALL_DECIDED = matching.DECISION_CTE.replace("WHERE NOT d.is_template", "").replace("FROM prints WHERE NOT is_template", "FROM prints")
ANALYZE_GREEN = f"""WITH decided AS ({_ALL_DECIDED} SELECT doc_id, traffic_light, template_id FROM decided), applied AS ({searching.APPLY_TEMPLATE})
SELECT a.doc_id, d.template_id, match_id, page_num, x0, y0, x1, y1, context, pattern FROM applied a JOIN decided d ON a.doc_id = d.doc_id WHERE d.traffic_light = 'green'"""


def analyze_yellow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the documents that went the way of the model."""
    rows = _analysis(spark, sf_dir).results.where("path = 'model'")
    return rows.select("doc_id", "traffic_light", "template_id", F.col("our_side.legal_entity").alias("our_entity"), "n_matches", "error")


ANALYZE_YELLOW = f"""WITH decided AS ({_ALL_DECIDED} SELECT doc_id, traffic_light, template_id FROM decided), auto AS ({AUTO_CTE} SELECT * FROM auto)
SELECT d.doc_id, traffic_light, template_id, CASE WHEN error IS NULL THEN entity END AS our_entity, n_matches, error FROM decided d JOIN auto a ON d.doc_id = a.doc_id WHERE traffic_light <> 'green'"""


def _locations(docs: DataFrame) -> DataFrame:
    pages_named = F.expr("array(3, 1, null, 3, 0, -1, 2, 99999, cast(1 + doc_id % 5 as int))")
    return docs.select("doc_id", F.explode(pages_named).alias("page"))


def pattern_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three texts from which patterns are extracted, made again and narrowed."""
    docs = contracts(spark, sf_dir)
    rows, asked = pages(docs), _locations(docs)
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    texts = pt.extraction_texts(rows).withColumnRenamed("text", "a").join(pt.regeneration_texts(rows, asked).withColumnRenamed("text", "b"), "doc_id").join(pt.narrowing_texts(rows, asked).withColumnRenamed("text", "c"), "doc_id")
    return texts.select("doc_id", digest("a").alias("extract_md5"), digest("b").alias("regenerate_md5"), digest("c").alias("narrow_md5"), F.length("b").alias("regenerate_size"))


_raw_block = lambda cut, banner: f"string_agg('--- Страница ' || (page_num + 1) || '{banner}' || chr(10) || substr(text, 1, {cut}), chr(10) || chr(10) ORDER BY page_num)"
PATTERN_TEXTS = PRELUDE + f""",
asked AS (SELECT DISTINCT doc_id, p - 1 AS page_num FROM (SELECT doc_id, unnest([3, 1, NULL, 3, 0, -1, 2, 99999, 1 + doc_id % 5]) AS p FROM contracts) WHERE p > 0),
raw AS (SELECT doc_id, {_raw_block(2500, " (сырой текст из PDF) ---")} AS b, {_raw_block(2000, " ---")} AS c FROM cpages JOIN asked USING (doc_id, page_num) GROUP BY doc_id),
chunks AS (SELECT doc_id, page_num, chr(10) || '--- Страница ' || (page_num + 1) || ' ---' || chr(10) || text AS t FROM cpages),
sums AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks),
ex AS (SELECT doc_id, string_agg(substr(t, 1, (5000 - before)::BIGINT), chr(10) ORDER BY page_num) AS a FROM sums WHERE before < 5000 GROUP BY doc_id)
SELECT doc_id, md5(a) AS extract_md5, md5(b) AS regenerate_md5, md5(c) AS narrow_md5, length(b)::INTEGER AS regenerate_size FROM ex JOIN raw USING (doc_id)"""

LOCATIONS = (("1", "LEASE AGREEMENT", "top"), ("99", "Lessor", "far"), ("last", "Lessor____________", None), ("last", "zz__", "c"), ("0", "x", "c"))


def llm_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pages(contracts(spark, sf_dir))
    n = docs.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    kinds = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p).alias("p"), F.lit(m).alias("text_marker"), F.lit(c).cast("string").alias("context")) for i, (p, m, c) in enumerate(LOCATIONS)])
    asked = n.select("doc_id", "n", F.explode(kinds).alias("k")).select("doc_id", "k.pos", F.when(F.col("k.p") == "last", F.col("n")).otherwise(F.col("k.p").try_cast("int")).alias("page"), "k.text_marker", "k.context")
    return se.located(docs, asked)


_rows = ", ".join(f"({i}, {_sql(p)}, {_sql(m)}, {'NULL' if c is None else _sql(c)})" for i, (p, m, c) in enumerate(LOCATIONS))
LLM_LOCATIONS = PAGE_LINES + f""",
k(pos, p, matched, context) AS (VALUES {_rows}), n AS (SELECT doc_id, count(*) AS n FROM plines GROUP BY doc_id),
a AS (SELECT n.doc_id, pos, CASE WHEN p = 'last' THEN n ELSE try_cast(p AS INTEGER) END - 1 AS page_num, matched, context FROM n, k),
j AS (SELECT a.*, L FROM a JOIN plines q ON a.doc_id = q.doc_id AND a.page_num = q.page_num),
r1 AS (SELECT *, {d_search("L", "matched", "e")} AS exact, {d_words("matched", "o")} AS words, {d_search("L", "'___'", "u")} AS us FROM j),
r2 AS (SELECT *, list_filter(list_transform(words, lambda w: {d_search("L", "w", "f")}), lambda x: len(x) > 0) AS hits FROM r1),
r3 AS (SELECT *, CASE WHEN len(exact) > 0 THEN exact WHEN len(hits) > 0 THEN hits[1][1:1] WHEN contains(matched, '__') THEN us[1:1] ELSE [] END AS rects FROM r2),
o AS (SELECT *, rects[i] AS r, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) AS num FROM (SELECT *, unnest(range(1, len(rects) + 1)) AS i FROM r3))
SELECT doc_id, 'llm_' || lpad(num::VARCHAR, greatest(3, len(num::VARCHAR))::INTEGER, '0') AS match_id, page_num::INTEGER AS page_num, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1, substr(coalesce(context, matched), 1, 100) AS context, 'llm_fallback' AS pattern, 0.7::DOUBLE AS confidence FROM o"""


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record per decision, for an append-only log."""
    rows = matcher.summary(matching._decided(spark, sf_dir))
    return matcher.log_records(rows, F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".pdf")), F.lit("2024-01-01T00:00:00+00:00"))


DECISION_LOG = f"""WITH d AS ({matching.DECISION_CTE} SELECT * FROM decided), x AS ({matching.TPL_EXPLAIN})
SELECT d.doc_id, '{{"timestamp":"2024-01-01T00:00:00+00:00","doc_filename":"doc' || d.doc_id || '.pdf","traffic_light":"' || traffic_light || '","best_score":' || coalesce(score::VARCHAR, 'null') || ',"best_template_id":' ||
  coalesce('"' || template_id || '"', 'null') || ',"candidates_count":' || least(5, n_candidates) || ',"explanation":"' || explanation || '"}}' AS record FROM d JOIN x ON d.doc_id = x.doc_id"""


def new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates saved from analysed documents: name, origin by the kind of their anchors, fingerprint sizes."""
    docs = contracts(spark, sf_dir)
    sizes = fp.sizes(pages(docs))
    anchors = F.expr("transform(sequence(0, cast(doc_id % 3 as int)), i -> if(i = 2, 'manual_click', 'auto_regex'))")
    origin = F.when(F.exists(anchors, lambda a: a == "manual_click"), "manual_enrichment").otherwise("pipeline_auto_1")
    name = rg.template_name(F.col("language"), F.lit("2024-01-01_0000"), F.concat(F.lit("Firm"), F.col("doc_id") % 7, F.lit(" LLC")))
    return docs.join(sizes, "doc_id").select("doc_id", name.alias("name"), origin.alias("created_by"), "page_count", "total_chars", F.lit(0).alias("times_applied"))


NEW_TEMPLATES = PRELUDE + """ SELECT c.doc_id, 'pipelineAuto1_2024-01-01_0000_' || c.language || '_Firm' || (c.doc_id % 7) || '_LLC' AS name, CASE WHEN c.doc_id % 3 = 2 THEN 'manual_enrichment' ELSE 'pipeline_auto_1' END AS created_by,
  count(*) AS page_count, CAST(sum(length(p.text)) AS BIGINT) AS total_chars, 0::INTEGER AS times_applied FROM contracts c JOIN cpages p ON c.doc_id = p.doc_id GROUP BY c.doc_id, c.language"""


def language_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given code, else the detected one, else ru; and the markers of that language, none where it has none."""
    rows = table(spark, sf_dir, "documents")
    given = F.expr("element_at(array('EN-us', 'de', '', 'pl', null), cast(1 + doc_id % 5 as int))")
    code = pr.language_code(given, F.col("lang"))
    markers = F.create_map(F.lit("ru"), F.lit("Подпись"), F.lit("en"), F.lit("Signature"))
    return rows.select("doc_id", code.alias("language"), F.coalesce(F.try_element_at(markers, code), F.lit("")).alias("marker"))


LANGUAGE_RESOLVE = """WITH g AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 5 = 3 THEN 'pl' WHEN lang = 'en' THEN 'en' ELSE 'ru' END AS language FROM documents)
SELECT doc_id, language, CASE language WHEN 'ru' THEN 'Подпись' WHEN 'en' THEN 'Signature' ELSE '' END AS marker FROM g"""

QUERIES = {f.__name__: f for f in (auto_pipeline, analyze_green, analyze_yellow, pattern_texts, llm_locations, decision_log, new_templates, language_resolve)}
SQL = {"auto_pipeline": AUTO_PIPELINE, "analyze_green": ANALYZE_GREEN, "analyze_yellow": ANALYZE_YELLOW, "pattern_texts": PATTERN_TEXTS, "llm_locations": LLM_LOCATIONS, "decision_log": DECISION_LOG, "new_templates": NEW_TEMPLATES, "language_resolve": LANGUAGE_RESOLVE}
