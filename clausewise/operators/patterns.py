"""Extraction, regeneration and narrowing of signing patterns: texts for the prompts, and the patterns of the replies.

A location is a page (from 1) on which a model saw a place to sign; pages that are null, below 1 or not in the document do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import replies as rp
from . import texts as ts

EXTRACT_CHARS, REGENERATE_CHARS, NARROW_CHARS = 5000, 2500, 2000
#: Page banners of the raw texts, and the line of one pattern's count.
RAW_BANNER, NARROW_BANNER = " (сырой текст из PDF) ---\n", " ---\n"
COUNT_ARROW, COUNT_UNIT = '" → ', " матчей"


def page_indexes(pages: Column) -> Column:
    """Page numbers (from 1) as sorted distinct indexes (from 0)."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(pages, lambda p: p > 0), lambda p: p - 1)))


def extraction_texts(pages: DataFrame, budget: int = EXTRACT_CHARS) -> DataFrame:
    """(doc_id, text): the document's beginning with page banners."""
    return ts.ordered_pages(pages).select("doc_id", ts.prefix(F.col("p"), budget, banners=True).alias("text"))


def located_texts(pages: DataFrame, locations: DataFrame, cut: int, banner: str) -> DataFrame:
    """(doc_id, text): the beginnings of the located pages, in page order and each page once; documents without one have no row.

    Only the located pages are joined, and only their first ``cut`` characters travel.
    """
    wanted = locations.where("page > 0").select("doc_id", (F.col("page") - 1).cast("int").alias("page_num")).distinct()
    blocks = pages.select("doc_id", "page_num", F.substring(F.coalesce("text", F.lit("")), 1, cut).alias("t")).join(wanted, ["doc_id", "page_num"])
    block = lambda x: F.concat(F.lit(ts.PAGE_BANNER), (x["page_num"] + 1).cast("string"), F.lit(banner), x["t"])
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "t"))), block), "\n\n").alias("text"))


def regeneration_texts(pages: DataFrame, locations: DataFrame) -> DataFrame:
    """Raw texts from which patterns are made again."""
    return located_texts(pages, locations, REGENERATE_CHARS, RAW_BANNER)


def narrowing_texts(pages: DataFrame, locations: DataFrame) -> DataFrame:
    """Raw texts against which greedy patterns are narrowed."""
    return located_texts(pages, locations, NARROW_CHARS, NARROW_BANNER)


def count_lines(counts: Column) -> Column:
    """Matches by pattern (array<struct<pattern, n>>) as lines of a prompt."""
    return F.array_join(F.transform(counts, lambda c: F.concat(F.lit('  - "'), c["pattern"], F.lit(COUNT_ARROW), c["n"].cast("string"), F.lit(COUNT_UNIT))), "\n")


def answered(replies: DataFrame) -> DataFrame:
    """(doc_id, patterns, error) from replies (doc_id, raw) that should be an array of patterns and nothing else.

    Items that are not strings go; a reply without a pattern is an error, a missing or unreadable one too.
    """
    found = F.coalesce(rp.string_items(F.col("raw")), F.array().cast("array<string>"))
    return replies.select("doc_id", found.alias("patterns")).select("doc_id", "patterns", F.when(F.size("patterns") == 0, "no patterns").alias("error"))
