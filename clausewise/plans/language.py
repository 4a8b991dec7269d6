"""Queries over texts, model replies and the registry tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import prompts as pr
from ..operators import registry as rg
from ..operators import replies as rp
from ..operators import texts as ts
from ..sources.contracts import PRELUDE, contracts, lines, pages, table
from .searching import _sql, d_distinct, d_strip, d_words


def _lit(text: str) -> str:
    return tx.quoted(text)


def _case(values, engine: str, by: str = "doc_id") -> str:
    """One of several texts by id, in either engine's spelling."""
    say = _lit if engine == "spark" else (lambda v: _sql(v))
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else say(v)}" for i, v in enumerate(values)) + " END"


# Words of lines ------------------------------------------------------------


def _line_words(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = lines(contracts(spark, sf_dir)).withColumn("line", F.concat(F.col("line"), F.lit(" «Бета Плюс» ООО 'Omega Two'")))
        return rows.select("doc_id", "line_no", F.array_join(fn(F.col("line")), "|").alias("words"))

    return query


anchor_words, alias_tokens, distinctive_tokens = (_line_words(f) for f in (tx.anchor_words, tx.alias_tokens, tx.distinctive_tokens))
_LINE = "line || ' «Бета Плюс» ООО ''Omega Two'''"
_list = lambda words: "[" + ", ".join(map(_sql, words)) + "]"
ANCHOR_WORDS = PRELUDE + f", t AS (SELECT doc_id, line_no, {_LINE} AS t FROM lines) SELECT doc_id, line_no::INTEGER AS line_no, array_to_string({d_words('t', 'a')}, '|') AS words FROM t"
_alias = f"list_filter(regexp_extract_all(translate(t, '«»\"''()/\\', '        '), '{tx.WORD}'), lambda y: len(y) >= 3 AND NOT list_contains({_list(tx.ALIAS_STOP_WORDS)}, lower(y)))"
ALIAS_TOKENS = PRELUDE + f", t AS (SELECT doc_id, line_no, {_LINE} AS t FROM lines), w AS (SELECT doc_id, line_no, {_alias} AS w FROM t) SELECT doc_id, line_no::INTEGER AS line_no, array_to_string({d_distinct('w', 'a')}, '|') AS words FROM w"
_quoted = f"list_filter(list_transform(regexp_extract_all(t, '[«\"'']([^»\"'']+)[»\"'']', 1), lambda q: {d_strip('q')}), lambda q: len(q) >= 3)"
_phrases = f"flatten(list_transform({_quoted}, lambda q: list_concat([q], list_filter(string_split_regex(q, '{tx.WS}+'), lambda w: len(w) >= 4))))"
_capital = f"list_filter(regexp_extract_all(t, '[А-ЯA-ZЁ][а-яa-zА-ЯA-ZёЁ\\-]{{3,}}'), lambda c: NOT list_contains({_list(tx.NAME_STOP_WORDS)}, lower(c)))"
DISTINCTIVE_TOKENS = PRELUDE + f", t AS (SELECT doc_id, line_no, {_LINE} AS t FROM lines), w AS (SELECT doc_id, line_no, list_concat({_phrases}, {_capital}) AS w FROM t) SELECT doc_id, line_no::INTEGER AS line_no, array_to_string({d_distinct('w', 'a')}, '|') AS words FROM w"


# Texts for prompts ---------------------------------------------------------

_docs = lambda spark, sf_dir: ts.ordered_pages(pages(contracts(spark, sf_dir)))
_digest = lambda c: [F.length(c).alias("size"), F.md5(c.cast("binary")).alias("digest")]
PAGE_CTE = PRELUDE + ", pg AS (SELECT doc_id, page_num AS i, text AS t, count(*) OVER (PARTITION BY doc_id) AS n, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cpages)"


def header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_digest(ts.header_text(F.col("p"))))


HEADER_TEXT = PAGE_CTE + f", h AS (SELECT doc_id, substr(string_agg('{ts.PAGE_BANNER}' || (i + 1) || ' ---' || chr(10) || t, chr(10) ORDER BY i), 1, 4000) AS h FROM pg WHERE i < 3 AND before < 3000 GROUP BY doc_id) SELECT doc_id, length(h)::INTEGER AS size, md5(h) AS digest FROM h"


def doc_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir)
    cut = lambda budget, banners=False: rows.select("doc_id", F.lit(budget).alias("budget"), *_digest(ts.prefix(F.col("p"), budget, banners)))
    return cut(2000).unionByName(cut(3000)).unionByName(cut(5000, True))


_until = lambda src, budget: f"SELECT doc_id, string_agg(left(c, ({budget} - b)::BIGINT), chr(10) ORDER BY o) AS h FROM (SELECT *, coalesce(sum(length(c)) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({src})) WHERE b < {budget} GROUP BY doc_id"
_BANNERED = f"chr(10) || '{ts.PAGE_BANNER}' || (i + 1) || ' ---' || chr(10) || t"
DOC_PREFIX = PAGE_CTE + f", z AS ({_until('SELECT doc_id, i AS o, t AS c FROM pg', 2000)}), a AS ({_until('SELECT doc_id, i AS o, t AS c FROM pg', 3000)}), b AS ({_until(f'SELECT doc_id, i AS o, {_BANNERED} AS c FROM pg', 5000)}) SELECT doc_id, 2000 AS budget, length(h)::INTEGER AS size, md5(h) AS digest FROM z UNION ALL SELECT doc_id, 3000, length(h)::INTEGER, md5(h) FROM a UNION ALL SELECT doc_id, 5000, length(h)::INTEGER, md5(h) FROM b"


def strategic_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("language") == "en", F.array(F.lit("section"), F.lit("annex"))).otherwise(F.array(F.lit("раздел"), F.lit("the")))
    return _docs(spark, sf_dir).select("doc_id", *_digest(ts.strategic_fragments(F.col("p"), words)))


STRATEGIC_FRAGMENTS = PAGE_CTE + f""", w AS (SELECT pg.*, language, {d_strip("t")} AS bare FROM pg JOIN contracts USING (doc_id)),
f AS (
  SELECT doc_id, 0 AS sec, i, '{ts.FIRST}'::VARCHAR || t AS c FROM w WHERE i = 0 UNION ALL SELECT doc_id, 1, i, '{ts.LAST}' || t FROM w WHERE i = n - 1 AND n > 1
  UNION ALL SELECT doc_id, 2, i, '{ts.PAGE}' || (i + 1) || ' ===' || chr(10) || substr(t, 1, 2000) FROM w WHERE i > 0 AND i < n - 1 AND CASE language WHEN 'en' THEN contains(lower(t), 'section') OR contains(lower(t), 'annex') ELSE contains(lower(t), 'раздел') OR contains(lower(t), 'the') END
  UNION ALL SELECT doc_id, 3, 0, '{ts.FOOTERS}' || string_agg('{ts.FOOTER}' || (i + 1) || '] ' || right(bare, 200), chr(10) || '---' || chr(10) ORDER BY i) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w WHERE bare <> '') WHERE k <= 20 GROUP BY doc_id
), h AS (SELECT doc_id, substr(string_agg(c, chr(10) || chr(10) ORDER BY sec, i), 1, 8000) AS h FROM f GROUP BY doc_id)
SELECT doc_id, length(h)::INTEGER AS size, md5(h) AS digest FROM h"""


def strategic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_digest(ts.strategic_text(F.col("p"))))


_marked = " OR ".join(f"contains(lower(t), '{m}')" for m in ts.SIGN_MARKERS)
STRATEGIC_TEXT = PAGE_CTE + f", o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 1 WHEN {_marked} THEN 2 ELSE 3 END, i) AS o, {_BANNERED} AS c FROM pg), h AS ({_until('SELECT * FROM o', 10000)}) SELECT doc_id, length(h)::INTEGER AS size, md5(h) AS digest FROM h"


# Replies -------------------------------------------------------------------

_SIDE = '{"our_side_index": 0, "confidence": %s, "our_side_synonyms": {"legal_entity": "Firm \\"Alfa\\" LLC", "roles": ["Lessor", "Owner"], "signer": "Ivanov Petr"}, "all_parties": [{"legal_entity": "Firm \\"Alfa\\" LLC", "role": "Lessor", "signer": "X"}, {"legal_entity": "OOO Gamma Trade", "role": "Lessee", "signer": "Sidorov Ivanov"}], "patterns": ["a_{3,}", {"pattern": " b "}, "", {"x": 1}, "a_{3,}"]}'
REPLIES = (_SIDE % "0.9", "```json\n" + _SIDE % "0.5" + "\n```", "Sure: " + _SIDE % "0.49" + " done", "no json here", '[1, "a", {"b": 2}]', '{"our_side_index": null, "confidence": 1}', '```\n["x_{3,}", 5, "y"]\n```', "")


def _replies(spark, sf_dir, values=REPLIES):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_case(values, "spark")).alias("raw"))


def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir)
    obj, arr = rp.json_object(F.col("raw")), rp.json_array(F.col("raw"))
    return rows.select("doc_id", F.coalesce(F.schema_of_variant(obj).startswith("OBJECT"), F.lit(False)).alias("is_object"), arr.isNotNull().alias("is_array"), F.array_join(rp.string_items(F.col("raw")), "|").alias("strings"), F.array_join(rp.reply_patterns(F.col("raw")), "|").alias("patterns"))


REPLY_CTE = f"WITH r AS (SELECT doc_id, {_case(REPLIES, 'duck')} AS raw FROM documents), x AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(raw, '(?m)^```(?:json)?', '', 'g'), ' ' || chr(10)), '(?m)```$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM r), y AS (SELECT *, try_cast(coalesce(nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), ''), t) AS JSON) AS o, try_cast(coalesce(nullif(regexp_extract(t, '(?s)\\[.*\\]'), ''), t) AS JSON) AS a, try_cast(t AS JSON) AS j FROM x)"
LLM_PARSE = REPLY_CTE + """ SELECT doc_id, coalesce(json_type(o) = 'OBJECT', false) AS is_object, coalesce(json_type(a) = 'ARRAY', false) AS is_array,
  CASE WHEN json_type(j) = 'ARRAY' THEN array_to_string(list_transform(list_filter(j::JSON[], lambda v: json_type(v) = 'VARCHAR'), lambda v: v->>'$'), '|') END AS strings,
  coalesce(array_to_string(list_filter(list_transform((o->'$.patterns')::JSON[], lambda v: trim(CASE WHEN json_type(v) = 'OBJECT' THEN coalesce(v->>'$.pattern', '') ELSE v->>'$' END)), lambda p: p <> ''), '|'), '') AS patterns FROM y"""


def our_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir).withColumn("s", rp.our_side(F.col("raw")))
    return rows.select("doc_id", "s.legal_entity", F.array_join("s.roles", "|").alias("roles"), "s.signer", "s.confidence", "s.error", F.when(F.col("s.error").isNull(), F.array_join(rp.other_aliases(F.col("s")), "|")).alias("other_aliases"))


OUR_SIDE = REPLY_CTE + """, z AS (SELECT *, coalesce(json_type(o) IN ('OBJECT', 'ARRAY'), false) AS parsed, coalesce(try_cast(o->>'$.confidence' AS DOUBLE), 0) AS c, o->>'$.our_side_index' AS i FROM y),
e AS (SELECT *, CASE WHEN NOT parsed THEN 'no JSON' WHEN i IS NULL OR c < 0.5 THEN 'side not found' END AS error FROM z)
SELECT doc_id, CASE WHEN error IS NULL THEN o->>'$.our_side_synonyms.legal_entity' END AS legal_entity, CASE WHEN error IS NULL THEN 'Lessor|Owner' END AS roles, CASE WHEN error IS NULL THEN o->>'$.our_side_synonyms.signer' END AS signer,
  CASE WHEN error IS NULL THEN c END AS confidence, error, CASE WHEN error IS NULL THEN 'Lessee|Gamma|Trade|Sidorov' END AS other_aliases FROM e"""


VERDICTS = ('[{"id": "sig_001", "confidence": 0.9, "is_signature": true}, {"id": "sig_002", "is_signature": false}]', 'so: [{"id": "sig_001", "confidence": 0.1, "is_signature": false}, {"id": "sig_001", "confidence": 0.7}]', "nothing", '[{"id": "sig_002", "confidence": 0.2, "is_signature": false}]', "[]")


def llm_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit("sig_001"), F.lit("sig_002"))).alias("match_id"))
    return rp.validated(matches, _replies(spark, sf_dir, VERDICTS)).select("doc_id", "match_id", "confidence", "status", "correction_applied")


LLM_VALIDATE = f"""WITH r AS (SELECT doc_id, try_cast(regexp_extract({_case(VERDICTS, 'duck')}, '(?s)\\[.*\\]') AS JSON) AS a FROM documents),
v AS (SELECT doc_id, pos, (a->('$[' || pos || ']')) AS v FROM (SELECT *, unnest(range(coalesce(json_array_length(a), 0)::BIGINT)) AS pos FROM r)),
l AS (SELECT doc_id, v->>'$.id' AS match_id, last(v ORDER BY pos) AS v FROM v GROUP BY ALL),
m AS (SELECT doc_id, unnest(['sig_001', 'sig_002']) AS match_id FROM documents)
SELECT m.doc_id, m.match_id, coalesce(try_cast(v->>'$.confidence' AS DOUBLE), 0.5) AS confidence, CASE WHEN v->>'$.is_signature' = 'false' THEN 'rejected_by_llm' ELSE 'candidate' END AS status, CASE WHEN v->>'$.is_signature' = 'false' THEN 'LLM' END AS correction_applied
FROM m LEFT JOIN l ON m.doc_id = l.doc_id AND m.match_id = l.match_id"""

RESOLVED = ('{"party": "Lessor", "confidence": 0.8, "evidence": "e1"}', '```json\n{"party": "арендатор и партнёры", "confidence": 0.6}\n```', '{"party": "null"}', '{"party": "Nobody", "evidence": "e3"}', "bad", '{"party": "OWN", "confidence": 1}')
PARTIES = (("Lessor", ("Арендодатель", "Owner")), ("Lessee", ("Арендатор", "Tenant")))


def party_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, a)).alias("aliases")) for n, a in PARTIES])
    return rp.resolved(_replies(spark, sf_dir, RESOLVED), known)


PARTY_MAP = f"""WITH r AS (SELECT doc_id, try_cast(trim(regexp_replace(regexp_replace({_case(RESOLVED, 'duck')}, '^```(?:json)?', ''), '```$', ''), ' ' || chr(10)) AS JSON) AS j FROM documents),
n AS (SELECT *, nullif(nullif(j->>'$.party', 'null'), '') AS said FROM r), known(o, name, aka) AS (VALUES (1, 'Lessor', ['lessor', 'арендодатель', 'owner']), (2, 'Lessee', ['lessee', 'арендатор', 'tenant'])),
p AS (SELECT *, coalesce((SELECT name FROM known WHERE name = said), (SELECT arg_min(name, o) FROM known WHERE len(list_filter(aka, lambda c: contains(c, lower(said)) OR contains(lower(said), c))) > 0)) AS party FROM n),
e AS (SELECT *, CASE WHEN j IS NULL THEN 'bad reply' WHEN said IS NULL THEN 'signer not found' WHEN party IS NULL THEN 'unknown party' END AS error FROM p)
SELECT doc_id, CASE WHEN error IS NULL THEN party END AS party, CASE WHEN error IS NULL THEN coalesce(try_cast(j->>'$.confidence' AS DOUBLE), 0) ELSE 0 END AS confidence, coalesce(j->>'$.evidence', '') AS evidence, error FROM e"""

PARTIES_JSON = '{"A": {"display": "Side A", "languages": {"en": {"aliases": ["Alpha"], "patterns": ["p1"]}, "ru": {"aliases": ["Альфа", "Бета"], "patterns": ["p2"]}}, "notes": "n"}, "B": {"languages": {"pl": {"aliases": [], "patterns": ["p3", "p4"]}}}}'


def parties_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "map<string, struct<display: string, notes: string, languages: map<string, struct<aliases: array<string>, patterns: array<string>>>>>"
    rows = contracts(spark, sf_dir).select("doc_id", F.explode(rp.parties_of_json(F.from_json(F.lit(PARTIES_JSON), kind), F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("language")))).alias("p"))
    return rows.select("doc_id", "p.name", "p.display", F.array_join("p.aliases", "|").alias("aliases"), F.array_join("p.patterns", "|").alias("patterns"), "p.notes")


PARTIES_JSON_SQL = PRELUDE + """, l AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE language END AS lang FROM contracts)
SELECT doc_id, 'A' AS name, 'Side A' AS display, CASE lang WHEN 'en' THEN 'Alpha' WHEN 'ru' THEN 'Альфа|Бета' ELSE 'Alpha|Альфа|Бета' END AS aliases, CASE lang WHEN 'en' THEN 'p1' WHEN 'ru' THEN 'p2' ELSE 'p1|p2' END AS patterns, 'n' AS notes FROM l
UNION ALL SELECT doc_id, 'B', 'B', '', 'p3|p4', '' FROM l"""

PARTIES_MD = ("## СТОРОНА: Альфа\naliases:\n- \"Alpha One\"\n-  Beta\nsign_patterns:\n- _{3,}\nnotes: \"a note\"\n---\n- stray\n## СТОРОНА: Two\nsign_patterns:\n- x\n---\n- \"\"\n", "aliases:\n- lost\n## СТОРОНА: Z\n", "no parties")


def parties_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.parties_of_md(_replies(spark, sf_dir, PARTIES_MD).withColumnRenamed("raw", "text"))
    return rows.select("doc_id", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join("patterns", "|").alias("patterns"), "notes")


PARTIES_MD_SQL = """SELECT doc_id, 'Альфа' AS name, 'Alpha One|Beta' AS aliases, '_{3,}' AS patterns, 'a note' AS notes FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'Two', '', 'x|--|', '' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'Z', '', '', '' FROM documents WHERE doc_id % 3 = 1"""


def merge_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns by label and language of all labelled documents, merged into those of every third."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("party"), F.col("lang").alias("language"), F.col("doc_id").alias("pos"), F.expr("concat('p', n_chars % 50)").alias("pattern"))
    return rp.merged_patterns(rows.where("pos % 3 = 0").select("party", "language", "pattern").distinct(), rows.where("pos % 3 <> 0")).groupBy("party", "language").agg(F.count("*").alias("added"), F.min("pos").alias("first_pos"))


MERGE_PATTERNS = """WITH r AS (SELECT source AS party, lang AS language, doc_id AS pos, 'p' || (n_chars % 50) AS pattern FROM documents),
n AS (SELECT party, language, pattern, min(pos) AS pos FROM r WHERE pos % 3 <> 0 GROUP BY ALL) SELECT party, language, count(*) AS added, min(pos) AS first_pos FROM n ANTI JOIN (SELECT * FROM r WHERE pos % 3 = 0) o USING (party, language, pattern) GROUP BY ALL"""


# Registry tables -----------------------------------------------------------


def _templates(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("template_id"), F.expr("concat('tpl', c_custkey % 11, if(c_custkey % 3 = 0, '', concat('_v', 2 + c_custkey % 5)))").alias("name"), F.expr("element_at(array('ru', 'en', 'pl'), cast(1 + c_custkey % 3 as int))").alias("language"))


TPL_CTE = "WITH tpl AS (SELECT c_custkey::VARCHAR AS template_id, 'tpl' || (c_custkey % 11) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '_v' || (2 + c_custkey % 5) END AS name, ['ru', 'en', 'pl'][1 + c_custkey % 3] AS language FROM customer)"


def tpl_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.listed(_templates(spark, sf_dir), "en").unionByName(rg.loaded(_templates(spark, sf_dir), "3"))


TPL_LIST = TPL_CTE + " SELECT * FROM tpl WHERE language = 'en' UNION ALL SELECT * FROM tpl WHERE template_id = '3'"


def tpl_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).cast("string").alias("template_id"), F.col("s_name").alias("name"), F.lit("pl").alias("language"))
    return rg.upserted(_templates(spark, sf_dir), new)


TPL_UPSERT = TPL_CTE + ", new AS (SELECT (s_suppkey * 20)::VARCHAR AS template_id, s_name AS name, 'pl' AS language FROM supplier) SELECT * FROM tpl ANTI JOIN new USING (template_id) UNION ALL SELECT * FROM new"


def tpl_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 30).cast("string").alias("template_id"))
    left, archive = rg.deleted(_templates(spark, sf_dir), ids, "20240101_000000")
    return left.withColumn("archive_path", F.lit(None).cast("string")).unionByName(archive)


TPL_ARCHIVE = TPL_CTE + ", ids AS (SELECT (s_suppkey * 30)::VARCHAR AS template_id FROM supplier) SELECT tpl.*, CASE WHEN ids.template_id IS NOT NULL THEN 'templates/_archive/' || tpl.template_id || '_20240101_000000.json' END AS archive_path FROM tpl LEFT JOIN ids USING (template_id)"


def tpl_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _templates(spark, sf_dir)
    return rg.next_version(rows, rows)


TPL_VERSION = TPL_CTE + ", b AS (SELECT *, regexp_replace(name, '_v[0-9]+$', '') AS base FROM tpl), names AS (SELECT DISTINCT language, name FROM tpl), v AS (SELECT b2.language, b2.base, min(v) AS v FROM (SELECT DISTINCT language, base FROM b) b2, range(2, 20) r(v) WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.language = b2.language AND n.name = b2.base || '_v' || v) GROUP BY ALL) SELECT template_id, base || '_v' || v AS new_name FROM b JOIN v USING (language, base)"


def add_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("template_id"), F.col("o_orderkey").alias("pos"), F.expr("if(o_orderkey % 13 = 0, null, concat('a', o_orderkey % 9))").alias("anchor_id"))
    old = rows.where("pos % 2 = 0").groupBy("template_id", "anchor_id").agg(F.min("pos").alias("pos")).select("template_id", "pos", "anchor_id")
    return rg.added_anchors(old, rows.where("pos % 2 = 1")).select("template_id", F.col("pos").cast("long").alias("pos"), "anchor_id")


ADD_ANCHORS = """WITH r AS (SELECT o_custkey AS template_id, o_orderkey AS pos, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'a' || (o_orderkey % 9) END AS anchor_id FROM orders),
o AS (SELECT template_id, anchor_id, min(pos) AS pos FROM r WHERE pos % 2 = 0 GROUP BY ALL), n AS (SELECT template_id, anchor_id, min(pos) AS pos FROM r WHERE pos % 2 = 1 GROUP BY ALL),
f AS (SELECT n.* FROM n LEFT JOIN o ON n.template_id = o.template_id AND n.anchor_id IS NOT DISTINCT FROM o.anchor_id WHERE o.template_id IS NULL)
SELECT template_id, row_number() OVER (PARTITION BY template_id ORDER BY late, pos) - 1 AS pos, anchor_id FROM (SELECT *, 0 AS late FROM o UNION ALL SELECT *, 1 FROM f)"""


def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("template_id"), F.expr("element_at(array('applied', 'confirmed', 'rejected', 'other'), cast(1 + event_id % 4 as int))").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    return rg.usage(_templates(spark, sf_dir), events)


USAGE_STATS = TPL_CTE + """, e AS (SELECT user_id::VARCHAR AS template_id, event_id % 4 AS e, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events)
SELECT tpl.template_id, count(*) FILTER (e = 0) AS times_applied, count(*) FILTER (e = 1) AS times_confirmed, count(*) FILTER (e = 2) AS times_rejected, max(ts) FILTER (e = 0) AS last_used FROM tpl LEFT JOIN e USING (template_id) GROUP BY tpl.template_id"""


def alias_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contracts(spark, sf_dir)
    full = F.expr("array(struct('ru' as language, 'Ромашка' as value), struct('en' as language, 'Daisy' as value), struct('en' as language, ' ' as value), struct('de' as language, concat('K', doc_id) as value))")
    code = F.when(F.col("doc_id") % 5 == 0, "EN-us").otherwise(F.col("language"))
    return rows.select("doc_id", F.array_join(rg.aliases_of(full, code), "|").alias("aliases"))


ALIAS_BY_LANG = PRELUDE + """, names AS (SELECT doc_id, left(lower(CASE WHEN doc_id % 5 = 0 THEN 'EN-us' ELSE language END), 2) AS code,
    list_filter([{'l': 'ru', 'v': 'Ромашка'}, {'l': 'en', 'v': 'Daisy'}, {'l': 'en', 'v': ' '}, {'l': 'de', 'v': 'K' || doc_id}], lambda a: trim(a.v) <> '') AS known FROM contracts),
picked AS (SELECT *, list_filter(known, lambda a: a.l = code) AS own FROM names)
SELECT doc_id, array_to_string(list_transform(CASE WHEN len(own) > 0 THEN own ELSE known END, lambda a: a.v), '|') AS aliases FROM picked"""


def ink_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 60 / 100.0).alias("c"), (F.col("l_partkey") % 500 + 1).cast("double").alias("w"), (F.col("l_suppkey") % 300).cast("double").alias("h"))
    return m.withColumn("r", rg.ink_confidence(F.col("c"), F.col("w"), F.col("h"), F.lit(500.0), F.lit(300.0))).select("l_orderkey", "l_linenumber", F.round("r.confidence", 6).alias("confidence"), F.array_join("r.warnings", ",").alias("warnings"))


INK_CONFIDENCE = """WITH m AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 60)::DOUBLE / 100 > 0.25 AS a, l_suppkey % 300 > 0 AND (l_partkey % 500 + 1)::DOUBLE / (l_suppkey % 300) < 1.2 AS b, l_partkey % 500 + 1 > 425 AND l_suppkey % 300 > 255 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 1::DOUBLE - CASE WHEN a THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN b THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN c THEN 0.5::DOUBLE ELSE 0 END)), 6) AS confidence, concat_ws(',', CASE WHEN a THEN 'dense' END, CASE WHEN b THEN 'narrow' END, CASE WHEN c THEN 'whole' END) AS warnings FROM m"""


def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    key = F.expr("case c_custkey % 4 when 0 then '' when 1 then concat('ab-cd-ef03-', c_custkey) when 2 then concat('key', c_custkey * 1000003) else c_name end")
    path = F.expr("concat(c_name, element_at(array('.PDF', '.docx', '.txt', ''), cast(1 + c_custkey % 4 as int)))")
    name = rg.template_name(F.lit("ru"), F.lit("2024-01-01_0000"), F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Lease of "), F.col("c_name"))))
    return rows.select("c_custkey", rg.masked_key(key).alias("masked"), pr.decoder_of(path).alias("decoder"), name.alias("template_name"))


NAMES_AND_KEYS = """WITH k AS (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ab-cd-ef03-' || c_custkey WHEN 2 THEN 'key' || (c_custkey * 1000003) ELSE c_name END AS k FROM customer)
SELECT c_custkey, CASE WHEN k = '' THEN '' WHEN len(string_split(k, '-')) >= 3 THEN array_to_string(string_split(k, '-')[1:3], '-') || '-***' ELSE substr(k, 1, 8) || '-***' END AS masked, CASE c_custkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'unsupported' END AS decoder,
  'pipelineAuto1_2024-01-01_0000_ru' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '_' || replace(substr('Lease of ' || c_name, 1, 20), ' ', '_') END AS template_name FROM k"""


def _prompts(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    known = F.array(F.struct(F.lit("Lessor").alias("name"), F.lit("Side A").alias("display"), F.array(F.lit("Owner"), F.lit("Арендодатель")).alias("aliases")), F.struct(F.lit("Lessee").alias("name"), F.lit(None).cast("string").alias("display"), F.array().cast("array<string>").alias("aliases")))
    rows = contracts(spark, sf_dir)
    text = pr.filled("Language {language}: {parties}\n{text}", {"language": F.col("language"), "parties": pr.party_lines(known), "text": value})
    return rows.select("doc_id", F.length(text).alias("size"), F.md5(text.cast("binary")).alias("digest"))


def prompts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, F.col("text"))


PROMPTS_WHOLE = PRELUDE + ", p AS (SELECT doc_id, 'Language ' || language || ': - \"Lessor\" (синонимы/языковые варианты: Owner, Арендодатель; отображение: Side A)' || chr(10) || '- \"Lessee\" (Lessee)' || chr(10) || text AS t FROM contracts) SELECT doc_id, length(t)::INTEGER AS size, md5(t) AS digest FROM p"


def prompt_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the seven prompts over whole contract texts, in short templates, each as its MD5."""
    rows = contracts(spark, sf_dir)
    odd, none = F.col("doc_id") % 2 == 1, F.array().cast("array<string>")
    places = F.expr("transform(sequence(0, cast(doc_id % 8 as int)), i -> struct(i + 1 as page, concat('place \"', i, '\"') as description, if(i % 2 = 0, null, concat('п', i)) as note))")
    places = F.when(F.col("doc_id") % 9 == 0, F.slice(places, 1, 0)).otherwise(places)
    fields = ("page", "description", "note")
    names = F.when(odd, F.array(F.lit("Daisy"), F.lit("{signer}"))).otherwise(none)
    person = F.when(odd, F.lit("{language} Ivanov")).otherwise("")
    previous = F.when(F.col("doc_id") % 4 == 1, F.struct(F.lit('["a"]').alias("patterns"), F.lit("[]").alias("found_locations")))
    items = F.transform(F.slice(places, 1, 2), lambda x: F.struct(F.concat(F.lit("sig_"), x["page"].cast("string")).alias("id"), x["page"].alias("page"), x["description"].alias("context"), x["note"].alias("pattern")))
    text, party = F.col("text"), F.lit("Lessor")
    made = {
        "side": pr.filled_once("{language}|{company_aliases}|{signer_aliases}|{markers}|{header_text}", pr.side_values(text, F.col("language"), names, none, F.lit("{}"))),
        "patterns": pr.filled("{legal_entity}|{roles}|{signer}|{language}|{underline_patterns}|{marker_words}|{strategic_fragments}", pr.pattern_values(F.lit(None).cast("string"), names, person, F.col("language"), names, none, text)),
        "extraction": pr.filled_once("{language}|{refinement}|{other}|{doc_text}", pr.extraction_values(text, party, F.col("language"), F.lit(""), F.lit(""), person, previous, "{patterns} {found_locations} {refinement}", "more {refinement}")),
        "regeneration": pr.filled_once("{party_name}\n{locations}\n{raw_text}", pr.regeneration_values(party, places, fields, text, F.lit(""))),
        "narrowing": pr.filled_once("{expected}|{actual}|{surplus}|{counts}|{locations}", pr.narrowing_values(party, places, fields, text, F.lit(7), F.lit("-"), F.lit(""))),
        "validation": pr.filled_once("{items}{party_name}", pr.validation_values(items, party, F.lit(""))),
        "resolver": pr.filled_once("{company}|{signer_name}|{parties}|{doc_text}", pr.resolver_values(text, party, person, F.lit("-"), F.lit(""))),
    }
    return rows.select("doc_id", *[F.md5(p.cast("binary")).alias(n) for n, p in made.items()])


PROMPT_VALUES = PRELUDE + """, r AS (SELECT doc_id, language, text, doc_id % 2 = 1 AS odd, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 8 + 1 END AS n FROM contracts),
q AS (SELECT *, '[' || chr(10) AS b, chr(10) || ']' AS e, CASE WHEN odd THEN 'Daisy, {signer}' ELSE '' END AS names, CASE WHEN odd THEN '{language} Ivanov' ELSE '' END AS person,
  list_transform(range(n), lambda i: ['  {', '    "page": ' || (i + 1) || ',', '    "description": "place \\"' || i || '\\"",', '    "note": ' || CASE WHEN i % 2 = 0 THEN 'null' ELSE '"п' || i || '"' END, '  }']) AS shown,
  list_transform(range(least(n, 2)), lambda i: ['  {', '    "id": "sig_' || (i + 1) || '",', '    "page": ' || (i + 1) || ',', '    "context": "place \\"' || i || '\\"",', '    "pattern": ' || CASE WHEN i % 2 = 0 THEN 'null' ELSE '"п' || i || '"' END, '  }']) AS found FROM r),
j AS (SELECT *, CASE WHEN n = 0 THEN '[]' ELSE b || array_to_string(list_transform(shown[1:5], lambda x: array_to_string(x, chr(10))), ',' || chr(10)) || e END AS places,
  CASE WHEN n = 0 THEN '[]' ELSE b || array_to_string(list_transform(found, lambda x: array_to_string(x, chr(10))), ',' || chr(10)) || e END AS items FROM q)
SELECT doc_id, md5(language || '|' || CASE WHEN odd THEN names ELSE '(не указано)' END || '|(не указано)|{}|' || text) AS side,
  md5('(не определено)|' || CASE WHEN odd THEN 'Daisy, ' || language || ' Ivanov|' || language || ' Ivanov' ELSE '(не определено)|(не определено)' END || '|' || language || '|' || names || '||' || text) AS patterns,
  md5(CASE language WHEN 'ru' THEN 'русском' WHEN 'en' THEN 'английском' ELSE 'польском' END || '|' || CASE WHEN NOT odd THEN '' WHEN doc_id % 4 = 1 THEN '["a"] [] ' || person ELSE 'more ' || person END || '|{other}|' || text) AS extraction,
  md5('Lessor' || chr(10) || places || chr(10) || text) AS regeneration, md5(n || '|7|' || (7 - n) || '|-|' || places) AS narrowing, md5(items || 'Lessor') AS validation,
  md5(CASE WHEN odd THEN 'Компания: "' || person || '"' ELSE 'Компания: (не указана)' END || '|Lessor|-|' || text) AS resolver FROM j"""


def settings_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings by nation: the first of two stored values, else the default; profiles merge by key."""
    n = table(spark, sf_dir, "nation")
    first, second = F.expr("if(n_nationkey % 3 = 0, 0.8D, null)"), F.expr("if(n_nationkey % 2 = 0, 0.9D, null)")
    stored = F.expr("if(n_nationkey % 4 = 0, map('version', '2.0'), map('updated_at', n_name))")
    merged = pr.merged_settings(F.expr("map('version', '1.0', 'updated_at', '')"), stored)
    return n.select("n_nationkey", pr.first_setting(first, second, F.lit(0.95)).alias("green_threshold"), merged["version"].alias("version"), merged["updated_at"].alias("updated_at"))


SETTINGS_FALLBACK = "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 0.8 WHEN n_nationkey % 2 = 0 THEN 0.9 ELSE 0.95 END::DOUBLE AS green_threshold, CASE WHEN n_nationkey % 4 = 0 THEN '2.0' ELSE '1.0' END AS version, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END AS updated_at FROM nation"

_names = "anchor_words alias_tokens distinctive_tokens header_text doc_prefix strategic_fragments strategic_text llm_parse our_side llm_validate party_map parties_json parties_md merge_patterns tpl_list tpl_upsert tpl_archive tpl_version add_anchors usage_stats alias_by_lang ink_confidence names_and_keys prompts_whole prompt_values settings_fallback"
QUERIES = {n: globals()[n] for n in _names.split()}
SQL = {n: globals()[n.upper()] for n in _names.split() if n not in ("parties_json", "parties_md")} | {"parties_json": PARTIES_JSON_SQL, "parties_md": PARTIES_MD_SQL}
