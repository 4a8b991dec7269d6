"""Texts cut from a document's pages for prompts: header, fragments, prefixes. One shuffle by document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Banners of the cut texts and the words that mark a page to sign (one is upper case on purpose:
#: it is looked for in lower-cased text and so never found).
PAGE_BANNER = "--- Страница "
FIRST, LAST, PAGE, FOOTERS = "=== ПЕРВАЯ СТРАНИЦА ===\n", "=== ПОСЛЕДНЯЯ СТРАНИЦА ===\n", "=== СТРАНИЦА ", "=== ФУТЕРЫ ===\n"
FOOTER = "[стр."
SIGN_MARKERS = ("подпись", "signature", "podpis", "___", "ФИО", "печать")


def ordered_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, language, p): the texts of each document's pages in order."""
    return pages.groupBy("doc_id").agg(F.first("language").alias("language"), F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"]).alias("p"))


def _until(chunks: Column, budget: int) -> Column:
    """Chunks in order until they fill the budget; the one that would pass it is cut. Separators do not count."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def step(a, c):
        over = a["total"] + F.length(c) >= budget
        part = F.when(over, F.substr(c, F.lit(1), budget - a["total"])).otherwise(c)
        return F.when(a["full"], a).otherwise(F.struct((a["total"] + F.length(part)).alias("total"), over.alias("full"), F.concat(a["out"], F.array(part)).alias("out")))

    return F.array_join(F.aggregate(chunks, zero, step, lambda a: a["out"]), "\n")


def _banner(i: Column) -> Column:
    return F.concat(F.lit(PAGE_BANNER), (i + 1).cast("string"), F.lit(" ---\n"))


def prefix(p: Column, budget: int, banners: bool = False) -> Column:
    """The document's beginning, with or without page banners."""
    chunks = F.transform(p, lambda t, i: F.concat(F.lit("\n"), _banner(i), t)) if banners else p
    return _until(chunks, budget)


def header_text(p: Column, pages: int = 3, enough: int = 3000, cut: int = 4000) -> Column:
    """The first pages with banners: at most three, none after ``enough`` characters."""
    before = lambda i: F.aggregate(F.slice(p, F.lit(1), i), F.lit(0), lambda s, t: s + F.length(t))
    used = F.filter(F.transform(p, lambda t, i: F.when((i < pages) & (before(i) < enough), F.concat(_banner(i), t))), lambda t: t.isNotNull())
    return F.substr(F.array_join(used, "\n"), F.lit(1), F.lit(cut))


def strategic_fragments(p: Column, keywords: Column, cut: int = 8000) -> Column:
    """First and last page, middle pages with a section keyword, and all footers."""
    n = F.size(p)
    none = F.array().cast("array<string>")
    middle = F.filter(F.transform(p, lambda t, i: F.when((i > 0) & (i < n - 1) & F.exists(keywords, lambda k: F.contains(F.lower(t), F.lower(k))), F.concat(F.lit(PAGE), (i + 1).cast("string"), F.lit(" ===\n"), F.substr(t, F.lit(1), F.lit(2000))))), lambda t: t.isNotNull())
    bare = F.transform(p, strip)
    feet = F.filter(F.transform(bare, lambda t, i: F.when(F.length(t) > 0, F.concat(F.lit(FOOTER), (i + 1).cast("string"), F.lit("] "), F.right(t, F.lit(200))))), lambda t: t.isNotNull())
    # A footer of white space alone is left out.
    footers = F.when(F.size(feet) > 0, F.array(F.concat(F.lit(FOOTERS), F.array_join(F.slice(feet, 1, 20), "\n---\n")))).otherwise(none)
    first = F.when(n > 0, F.array(F.concat(F.lit(FIRST), F.get(p, F.lit(0))))).otherwise(none)
    last = F.when(n > 1, F.array(F.concat(F.lit(LAST), F.element_at(p, -1)))).otherwise(none)
    return F.substr(F.array_join(F.concat(first, last, middle, footers), "\n\n"), F.lit(1), F.lit(cut))


def strategic_text(p: Column, budget: int = 10_000) -> Column:
    """Pages by use: first, last, those with a signing marker, the rest; cut at the budget."""
    n = F.size(p)
    marked = lambda t: F.greatest(*[F.contains(F.lower(t), F.lit(m)) for m in SIGN_MARKERS])
    rank = F.transform(p, lambda t, i: F.struct(F.when(i == 0, 0).when(i == n - 1, 1).when(marked(t), 2).otherwise(3).alias("rank"), i.alias("i"), F.concat(F.lit("\n"), _banner(i), t).alias("t")))
    return _until(F.transform(F.array_sort(rank), lambda r: r["t"]), budget)
