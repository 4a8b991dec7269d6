"""Queries over very many parties, the customers, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parties as pa
from ..sources.contracts import PRELUDE, contracts, pages, table
from . import searching as sg

#: Lines of a contract's annex, of which {0} is its customer and {1} the next one; and the patterns of a party.
ANNEX = ("Annex of {0}", "Tenant {0}: ____", "Guarantor {1} for {0}: _____", "Witness {0}, {1} _______", "for the rest see {1}")
PATTERNS = ("Tenant {0}: *_{{3,}}", "Guarantor [^:\\n]* for {0}: _{{3,}}", "[[]?Witness {0}, .*_{{,9}}_{{3,}}", "(a)?(?(1){0}|x)")


def _annexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page more for every contract, on which two customers are named."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    n = customers.count()
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 7) % n).alias("c_custkey")).withColumn("other", (F.col("c_custkey") + 1) % n)
    rows = docs.join(customers, "c_custkey").join(customers.select(F.col("c_custkey").alias("other"), F.col("c_name").alias("next")), "other")
    text = F.concat(*[F.concat(F.replace(F.replace(F.lit(x), F.lit("{0}"), F.col("c_name")), F.lit("{1}"), F.col("next")), F.lit("\n")) for x in ANNEX])
    return rows.select("doc_id", F.lit(1_000_000).alias("page_num"), text.alias("text"))


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [F.replace(F.lit(p.replace("{{", "{").replace("}}", "}")), F.lit("{0}"), F.col("c_name")) for p in PATTERNS]
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("party_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.array(*patterns).alias("patterns"), F.array("c_name").alias("aliases"), F.lit("").alias("signer"), F.array().cast("array<string>").alias("other_aliases")
    )


def party_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's places on all pages, those that name another customer excluded."""
    rows = pages(contracts(spark, sf_dir)).select("doc_id", "page_num", "text").unionByName(_annexes(spark, sf_dir))
    return pa.find_parties(rows, _parties(spark, sf_dir), rivals=True)


_line = lambda text: "'" + text.replace("{0}", "' || c.c_name || '").replace("{1}", "' || o.c_name || '") + "'"
_form = {0: "'(?i)Tenant ' || c_name || ': *_{3,}'", 1: "'(?i)Guarantor [^:\n]* for ' || c_name || ': _{3,}'", 2: "'(?i)\\[?Witness ' || c_name || ', .*_{0,9}_{3,}'"}
_text = {i: "'" + p.replace("{{", "{").replace("}}", "}").replace("{0}", "' || c_name || '") + "'" for i, p in enumerate(PATTERNS)}
#: Pages that name customers, each under a number of its own for document and customer.
PAGES = PRELUDE + f""",
nc AS (SELECT count(*) AS n FROM customer),
annex AS (
  SELECT doc_id, 1000000 AS page_num, {" || chr(10) || ".join(map(_line, ANNEX))} || chr(10) AS text
  FROM (SELECT doc_id, (doc_id * 7) % n AS k, ((doc_id * 7) % n + 1) % n AS k2 FROM documents, nc) d JOIN customer c ON c.c_custkey = k JOIN customer o ON o.c_custkey = k2
),
every AS (SELECT doc_id, page_num, text FROM cpages UNION ALL SELECT * FROM annex),
named AS (SELECT e.*, c_custkey, c_name FROM every e JOIN customer ON contains(lower(e.text), lower(c_name)) WHERE contains(e.text, '___')),
pl AS (SELECT doc_id * 1000000 + c_custkey AS doc_id, page_num, text, string_split(text, chr(10))[1:-2] AS L, c_name FROM named)"""
_cands = " UNION ALL ".join(f"SELECT doc_id, page_num, text, L, {i} AS pattern_idx, {_text[i]} AS pattern, c_name, unnest({sg.d_spans('text', f, 'c')}) AS s FROM pl WHERE regexp_matches(text, {f})" for i, f in _form.items())
_rivals = "SELECT * FROM ({0}) k WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_name <> k.c_name AND contains(lower(k.s.matched), lower(x.c_name)))"
PARTY_SEARCH = f"""SELECT doc_id // 1000000 AS doc_id, doc_id % 1000000 AS party_id, match_id, page_num, x0, y0, x1, y1, context, pattern
FROM ({sg.find_sql(sg.find_cte(PAGES, candidates=_rivals.format(_cands), others=()))})"""


def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as replies give them: with words around a customer's name, cut short, in other letters, unknown."""
    n = table(spark, sf_dir, "customer").count()
    said = F.expr(f"case doc_id % 6 when 0 then concat(' the ', c_name, ' company') when 1 then substr(c_name, 1, 17) when 2 then upper(c_name) when 3 then 'Nobody' when 4 then '' else concat('x', substr(c_name, 2)) end")
    names = table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 7) % n).alias("c_custkey")).join(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("doc_id").alias("name_id"), said.alias("name"))
    return pa.known_parties(names, _parties(spark, sf_dir)).select(F.col("name_id").alias("doc_id"), "party_id")


PARTY_NAMES = """
WITH nc AS (SELECT count(*) AS n FROM customer),
said AS (
  SELECT doc_id, lower(trim(CASE doc_id % 6 WHEN 0 THEN ' the ' || c_name || ' company' WHEN 1 THEN substr(c_name, 1, 17) WHEN 2 THEN upper(c_name) WHEN 3 THEN 'Nobody' WHEN 4 THEN '' ELSE 'x' || substr(c_name, 2) END)) AS name
  FROM documents, nc JOIN customer ON c_custkey = (doc_id * 7) % n
),
fits AS (SELECT s.doc_id, min(c_custkey) AS party_id FROM said s JOIN customer ON name <> '' AND (contains(name, lower(c_name)) OR contains(lower(c_name), name)) GROUP BY s.doc_id)
SELECT s.doc_id, party_id FROM said s LEFT JOIN fits f ON s.doc_id = f.doc_id"""

QUERIES = {f.__name__: f for f in (party_search, party_names)}
SQL = {"party_search": PARTY_SEARCH, "party_names": PARTY_NAMES}
