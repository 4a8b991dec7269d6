"""Queries on pages of words with boxes, of uneven widths, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clicks as ck
from ..operators import placement as pl
from ..operators import search as se
from ..sources.contracts import PRELUDE, contracts, word_pages
from . import searching as sg

_pages = lambda spark, sf_dir: word_pages(contracts(spark, sf_dir))

WORDS = PRELUDE + """,
token AS (SELECT *, parts[n] AS tok FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, page_num, line_no, line_in_page, string_split(line, ' ') AS parts FROM lines))),
wide AS (SELECT *, CASE WHEN tok = '' THEN 0 ELSE list_sum(list_transform(string_split(tok, ''), lambda c: 3 + unicode(c) % 5)) END::DOUBLE AS wd FROM token),
word AS (SELECT *, 50 + coalesce(sum(wd + 5) OVER (PARTITION BY doc_id, line_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0, 50::DOUBLE + 20 * line_in_page AS y0 FROM wide)"""
#: Pages with the layout L: the words' packed text and, of each word, where it starts in it, its size and its box.
PAGES = WORDS + """,
started AS (
  SELECT *, len(lower(tok)) AS sz, coalesce(sum(len(lower(tok)) + 1) OVER (PARTITION BY doc_id, page_num ORDER BY line_no, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM word WHERE tok <> ''
),
packed AS (SELECT doc_id, page_num, string_agg(lower(tok), chr(31) ORDER BY line_no, n) AS t, list({'st': st, 'sz': sz, 'x0': x0, 'x1': x0 + wd, 'y0': y0} ORDER BY line_no, n) AS w FROM started GROUP BY doc_id, page_num),
plines AS (SELECT c.doc_id, c.page_num, c.text, {'t': coalesce(t, ''), 'w': coalesce(w, [])} AS L FROM cpages c LEFT JOIN packed p ON c.doc_id = p.doc_id AND c.page_num = p.page_num)"""


def d_search(layout: str, needle: str, v: str) -> str:
    """Rectangles of a text among a page's words, one a line; ``v`` keeps the lambdas' names apart."""
    plain = f"replace({sg.d_strip(f"regexp_replace(lower({needle}), '{tx.WS}+', ' ', 'g')")}, ' ', chr(31))"
    parts = f"string_split({layout}.t, {plain})"
    at = f"CAST(coalesce(list_sum(list_transform({parts}[1:k{v}], lambda p{v}: len(p{v}))), 0) + (k{v} - 1) * len({plain}) AS BIGINT)"
    held = f"list_filter({layout}.w, lambda w{v}: w{v}.st < c{v} + len({plain}) AND w{v}.st + w{v}.sz > c{v})"
    share = lambda part: f"x{v}.x0 + (x{v}.x1 - x{v}.x0) * {part} / x{v}.sz"
    on_line = f"list_filter({held}, lambda z{v}: z{v}.y0 = y{v})"
    left = f"list_min(list_transform({on_line}, lambda x{v}: {share(f'greatest(0, c{v} - x{v}.st)')}))"
    right = f"list_max(list_transform({on_line}, lambda x{v}: {share(f'least(x{v}.sz, c{v} + len({plain}) - x{v}.st)')}))"
    lines = f"list_sort(list_distinct(list_transform({held}, lambda u{v}: u{v}.y0)))"
    rects = f"list_transform({lines}, lambda y{v}: {{'x0': {left}, 'y0': y{v}, 'x1': {right}, 'y1': y{v} + 12}})"
    found = f"list_transform(list_transform(range(1, len({parts})), lambda k{v}: {at}), lambda c{v}: {rects})"
    return f"(CASE WHEN len({plain}) > 0 THEN flatten({found}) ELSE [] END)"


def word_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.find_signatures(_pages(spark, sf_dir), sg.PARTY)


def word_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts(spark, sf_dir)
    return se.apply_anchors(word_pages(docs), sg.anchor_table(docs.select("doc_id")))


def word_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir)
    return pl.placements(sg._reviewed(se.find_signatures(rows, sg.PARTY)), rows, pl.Options(scale=1.5, aspect=2.5, marker_color="gray"))


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ck.word_blocks(_pages(spark, sf_dir))
    return rows.select("doc_id", "page_num", "block_no", "text", *[F.col(f"r.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


WORD_LINES = WORDS + """,
w AS (SELECT doc_id, page_num, line_no, string_agg(tok, ' ' ORDER BY n) AS text, min(x0) AS x0, min(y0) AS y0, max(x0 + wd) AS x1, min(y0) + 12 AS y1 FROM word WHERE tok <> '' GROUP BY doc_id, page_num, line_no)
SELECT doc_id, page_num::INTEGER AS page_num, (row_number() OVER (PARTITION BY doc_id, page_num ORDER BY line_no) - 1)::INTEGER AS block_no, text, x0, y0, x1, y1 FROM w"""

QUERIES = {f.__name__: f for f in (word_signatures, word_anchors, word_placements, word_lines)}
SQL = {
    "word_signatures": sg.find_sql(sg.find_cte(PAGES, d_search)), "word_anchors": sg.apply_sql(PAGES, d_search), "word_placements": sg.placements_sql(PAGES, d_search), "word_lines": WORD_LINES,
}
