"""Fingerprints of contract documents: sizes, header page, SimHash of the header, section titles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS, strip

#: Words of a contract's preamble, by language; others use ru.
PREAMBLE_MARKERS = {
    "ru": ["именуем", "в лице", "настоящ", "заключил", "с одной стороны"],
    "en": ["hereinafter", "represented by", "between", "agreed as follows"],
    "pl": ["umow", "zawart", "reprezentowan", "zwan"],
}
#: Fixed value: what a section title looks like; searched anywhere in a line, case matters.
SECTION_TITLE = (
    r"(\p{Nd}+\." + WS + r"+[А-ЯA-Z]"
    r"|РАЗДЕЛ|ПРИЛОЖЕНИЕ|АКТ|СТАТЬЯ"
    r"|Section|Annex|Appendix|Schedule|Article"
    r"|Część|Załącznik|Rozdział|Artykuł)"
)
HEADER_CHARS = 300
HEADER_PAGES = 3
TITLE_CHARS = 200
GRAM = 4
#: Grams hashed and counted at once: a bound of a worker's memory, not of the text.
GRAMS_AT_ONCE = 1 << 16


def sizes(pages: DataFrame) -> DataFrame:
    """Per document: page_count, total_chars, chars_per_page (array in page order)."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.sum(F.length("text")).alias("total_chars"),
        F.transform(F.array_sort(F.collect_list(F.struct("page_num", F.length("text").alias("n")))), lambda x: x["n"]).alias("chars_per_page"),
    )


def _header_rank(language: Column) -> Column:
    """Order of a page as the document's header, least first; null for pages that cannot be it.

    A page with enough characters and a marker of the language, else one with enough characters, else the first page.
    """
    solid = F.length(F.regexp_replace("text", f"{WS}+", "")) >= HEADER_CHARS
    low = F.lower("text")
    code = F.lower(F.substring(language, 1, 2))
    has = lambda words: F.greatest(*[low.contains(w) for w in words])
    marked = F.when(code == "en", has(PREAMBLE_MARKERS["en"])).when(code == "pl", has(PREAMBLE_MARKERS["pl"])).otherwise(has(PREAMBLE_MARKERS["ru"]))
    kind = F.when(solid & marked, 0).when(solid, 1).when(F.col("page_num") == 0, 2)
    return F.when(F.col("page_num") < HEADER_PAGES, kind * HEADER_PAGES + F.col("page_num"))


def header_page(pages: DataFrame) -> DataFrame:
    """Per document the page that holds the preamble, of its first pages: (doc_id, header_page)."""
    first = pages.where(F.col("page_num") < HEADER_PAGES)
    return first.groupBy("doc_id").agg(F.coalesce(F.min_by("page_num", _header_rank(F.col("language"))), F.lit(0)).alias("header_page"))


def _grams(codes, starts, sizes):
    """The grams at some places of a run of code points, as rows of ``GRAM`` (zeros beyond a gram's size)."""
    at = np.arange(GRAM)
    wide = codes[np.minimum(starts[:, None] + at, len(codes) - 1)]
    return np.where(at < sizes[:, None], wide, 0)


def _bits(grams, text: str, starts, sizes):
    """The 64 bits of each gram, each distinct one hashed once; and which row each gram has. Gram i is ``text`` from starts[i] on."""
    letters, dense = np.unique(grams, return_inverse=True)
    dense = dense.reshape(grams.shape)
    if len(letters) <= 1 << 16:  # four letters of so few make one number
        key = (dense.astype(np.uint64) << (np.uint64(16) * np.arange(GRAM, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
        _, pick, row = np.unique(key, return_index=True, return_inverse=True)
    else:
        _, pick, row = np.unique(dense, axis=0, return_index=True, return_inverse=True)
    found = [text[i : i + n] for i, n in zip(starts[pick].tolist(), sizes[pick].tolist(), strict=True)]
    hashed = np.frombuffer(b"".join([hashlib.md5(t.encode()).digest()[8:] for t in found]), np.uint8).reshape(-1, 8)
    return np.unpackbits(hashed, axis=1), row.reshape(-1)


@F.pandas_udf(T.LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    out, given = [None] * len(texts), [(i, t) for i, t in enumerate(texts) if t is not None]
    while given:
        # Texts whose grams are looked at together; a longer one stands alone and is read in parts.
        size, some = 0, []
        while given and (not some or size + len(given[0][1]) <= GRAMS_AT_ONCE):
            some.append(given.pop(0))
            size += len(some[-1][1])
        joined = "".join(t for _, t in some)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        length = np.array([len(t) for _, t in some])
        n = np.maximum(1, length - GRAM + 1)
        begin, first = np.cumsum(length) - length, np.concatenate(([0], np.cumsum(n)))
        counts = np.zeros((len(some), 64), np.int64)
        for lo in range(0, first[-1], GRAMS_AT_ONCE):
            at = np.arange(lo, min(lo + GRAMS_AT_ONCE, first[-1]))
            text = np.searchsorted(first, at, side="right") - 1
            starts = begin[text] + at - first[text]
            sizes = np.minimum(length[text], GRAM)
            bits, row = _bits(_grams(codes, starts, sizes) if len(codes) else np.zeros((len(at), GRAM), np.uint32), joined, starts, sizes)
            new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            counts[text[new]] += np.add.reduceat(bits[row], new, axis=0, dtype=np.int64)
        for (i, _), h in zip(some, np.packbits(2 * counts > n[:, None], axis=1).view(">i8").reshape(-1).tolist(), strict=True):
            out[i] = h
    return pd.Series(out, dtype="Int64")


def simhash(text: Column) -> Column:
    """64-bit SimHash of 4-character grams, as bigint in two's complement; null for null.

    Lower-cased letters, digits and underscores; a text shorter than four is one gram. A bit is set if more
    than half of all grams have it in the low half of their MD5.
    """
    return _simhash(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", ""))


def _header_hashes(pages: DataFrame) -> DataFrame:
    """Adds the header order and, for pages that can be the header, the SimHash: 8 bytes a page are shuffled, no text."""
    ranked = pages.withColumn("_rank", _header_rank(F.col("language")))
    return ranked.withColumn("_hash", simhash(F.when(F.col("_rank").isNotNull(), F.col("text"))))


def header_simhash(pages: DataFrame) -> DataFrame:
    """(doc_id, simhash) of every document's header page."""
    hashed = _header_hashes(pages.where(F.col("page_num") < HEADER_PAGES)).where("_rank is not null")
    return hashed.groupBy("doc_id").agg(F.min_by("_hash", "_rank").alias("simhash"))


def section_titles(lines: DataFrame) -> DataFrame:
    """(doc_id, titles): section titles of a document in order, each once."""
    title = strip(F.col("line"))
    found = lines.select("doc_id", "line_no", title.alias("title")).where((F.length("title") > 0) & (F.length("title") <= TITLE_CHARS) & F.col("title").rlike(SECTION_TITLE))
    first = found.groupBy("doc_id", "title").agg(F.min("line_no").alias("at"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]).alias("titles"))


def fingerprints(docs: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """All parts of the fingerprint of every document that has pages: one pass and one aggregation of the pages, one of the titles."""
    sized = _header_hashes(pages).select("doc_id", "page_num", F.length("text").alias("n"), "_rank", "_hash")
    parts = sized.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.sum("n").alias("total_chars"), F.transform(F.array_sort(F.collect_list(F.struct("page_num", "n"))), lambda x: x["n"]).alias("chars_per_page"),
        F.coalesce(F.min_by("page_num", "_rank"), F.lit(0)).alias("header_page"), F.min_by("_hash", "_rank").alias("simhash"),
    )
    return (
        docs.select("doc_id", "language", "is_template").join(parts, "doc_id").join(section_titles(lines), "doc_id", "left")
        .withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    )
