"""Contract documents: derived tables that stand in for decoded files.

Decoding PDF or DOCX is a pluggable boundary (see ``files.py``); everything behind it works on these
tables. The synthetic contracts wrap each row of ``documents`` in a preamble, section titles and two
signature lines, three lines to a page; the layout is monospaced, in points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let

LINES_PER_PAGE = 3
PAGE_WIDTH = 595.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, language, is_template, text)."""
    text = F.concat_ws(
        "\n", F.concat(F.lit("LEASE AGREEMENT No "), F.col("doc_id")),
        F.concat(F.lit("Firm"), F.col("doc_id") % 7, F.lit(" LLC, hereinafter the Lessor, represented by Ivanov, between the parties")), "text",
        F.concat(F.lit("Section "), 1 + F.col("doc_id") % 4, F.lit(". Payment")), F.concat(F.lit("Annex No "), 1 + F.col("doc_id") % 3),
        F.concat(F.lit("Lessor: "), F.expr("repeat('_', cast(5 + doc_id % 20 as int))"), F.lit(" /Ivanov I.I./")),
        F.concat(F.lit("Lessee: "), F.expr("repeat('_', cast(5 + doc_id % 11 as int))"), F.lit(" /Petrov P.P./")),
    )
    language = F.when(F.col("lang") == "en", "en").when(F.col("lang") == "de", "ru").otherwise("pl")
    return table(spark, sf_dir, "documents").select("doc_id", language.alias("language"), (F.col("doc_id") % 10 == 0).alias("is_template"), text.alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, language, is_template, line_no, page_num, line_in_page, line)."""
    rows = docs.select("doc_id", "language", "is_template", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    page = F.expr(f"line_no div {LINES_PER_PAGE}").cast("int")
    return rows.select("doc_id", "language", "is_template", "line_no", page.alias("page_num"), (F.col("line_no") % LINES_PER_PAGE).alias("line_in_page"), "line")


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, language, is_template, page_num, text), cut inside each row: no shuffle."""
    count = lambda parts: F.ceil(F.size(parts) / F.lit(LINES_PER_PAGE)).cast("int")
    page = lambda parts: lambda p: F.concat(F.array_join(F.slice(parts, p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"), F.lit("\n"))
    text = let(F.split("text", "\n"), lambda parts: F.transform(F.sequence(F.lit(0), count(parts) - 1), page(parts)))
    return docs.select("doc_id", "language", "is_template", F.posexplode(text).alias("page_num", "text"))


SIDES = ("x0", "y0", "x1", "y1")
WORDS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in SIDES)]))
_WORD = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in SIDES)])


@F.arrow_udf(WORDS)
def _boxed(texts: pa.Array) -> pa.Array:
    """The words of pages of text, from left to right on each line."""
    found, x0, y0, x1, first, wide = [], [], [], [], [0], {}
    for text in texts.to_pylist():
        for row, line in enumerate((text or "").split("\n")[:-1]):
            x, y = 50.0, 50.0 + 20.0 * row
            for word in line.split(" "):
                if word:
                    if word not in wide:
                        wide[word] = float(sum(3 + ord(c) % 5 for c in word))
                    found.append(word), x0.append(x), y0.append(y)
                    x += wide[word]
                    x1.append(x)
                x += 5.0
        first.append(len(found))
    low = np.array(y0, dtype=float)
    columns = [pa.array(found, pa.string()), *(pa.array(c, pa.float64()) for c in (x0, low, x1, low + 12.0))]
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_WORD)))


def word_pages(docs: DataFrame) -> DataFrame:
    """``pages`` as a decoder gives them: with ``words`` (text and box, in reading order) of a font whose characters are 3 to 7 points wide by their code."""
    return pages(docs).withColumn("words", _boxed("text"))


def box(line_in_page, col, size):
    """Layout rule: rectangle of ``size`` characters from column ``col``."""
    y0 = 50.0 + 20.0 * line_in_page
    return F.struct((50.0 + 5.0 * col).alias("x0"), y0.alias("y0"), (50.0 + 5.0 * (col + size)).alias("x1"), (y0 + 12.0).alias("y1"))


#: The same tables in DuckDB; queries are prefixed with it.
PRELUDE = """
WITH contracts AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'ru' ELSE 'pl' END AS language, doc_id % 10 = 0 AS is_template,
    'LEASE AGREEMENT No ' || doc_id || chr(10) ||
    'Firm' || (doc_id % 7) || ' LLC, hereinafter the Lessor, represented by Ivanov, between the parties' || chr(10) ||
    text || chr(10) || 'Section ' || (1 + doc_id % 4) || '. Payment' || chr(10) || 'Annex No ' || (1 + doc_id % 3) || chr(10) ||
    'Lessor: ' || repeat('_', 5 + doc_id % 20) || ' /Ivanov I.I./' || chr(10) ||
    'Lessee: ' || repeat('_', 5 + doc_id % 11) || ' /Petrov P.P./' AS text
  FROM documents
),
lines AS (
  SELECT doc_id, language, is_template, i AS line_no, i // 3 AS page_num, i % 3 AS line_in_page, parts[i + 1] AS line
  FROM (SELECT *, unnest(range(len(parts))) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM contracts))
),
cpages AS (
  SELECT doc_id, language, is_template, page_num, string_agg(line || chr(10), '' ORDER BY line_no) AS text
  FROM lines GROUP BY doc_id, language, is_template, page_num
)"""
