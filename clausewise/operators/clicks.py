"""Clicks of an operator to anchors: the nearest text block by four levels, its position and a signature box."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import text as tx
from ..sources.contracts import SIDES, box
from .search import page_hint

NEAR, ROW, FAR, UNDERLINE = 30.0, 10.0, 200.0, 50.0
LINE = r"[_\.]{5,}"


def blocks(lines: DataFrame) -> DataFrame:
    """One text block per line: (doc_id, page_num, block_no, text, r)."""
    return lines.select("doc_id", "page_num", F.col("line_in_page").alias("block_no"), F.col("line").alias("text"), box(F.col("line_in_page"), F.lit(0), F.length("line")).alias("r"))


_RECT = T.StructType([T.StructField(c, T.DoubleType()) for c in SIDES])
BLOCKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("r", _RECT)]))


@F.arrow_udf(BLOCKS)
def _blocks(words: pa.Array) -> pa.Array:
    """The lines of pages of words, in reading order."""
    sizes, every = words.value_lengths().fill_null(0).to_numpy(), words.flatten()
    box = {c: every.field(c).to_numpy(zero_copy_only=False) for c in SIDES} if len(every) else {c: np.zeros(0) for c in SIDES}
    middle = (box["y0"] + box["y1"]) / 2
    page = np.repeat(np.arange(len(sizes)), sizes)
    opens = np.ones(len(page), dtype=bool)
    opens[1:] = (page[1:] != page[:-1]) | ~((np.abs(middle[:-1] - middle[1:]) <= geo.SAME_LINE) & (box["x0"][1:] >= box["x0"][:-1]))
    first = np.flatnonzero(opens)
    texts, ends = every.field("text").to_pylist() if len(every) else [], np.append(first[1:], len(page))[: len(first)]
    joined = pa.array([" ".join([t for t in texts[lo:hi] if t is not None]) for lo, hi in zip(first.tolist(), ends.tolist(), strict=True)], pa.string())
    # The least and greatest of a line, null sides apart.
    ends_of = {c: (np.fmin if c.endswith("0") else np.fmax).reduceat(box[c], first) if len(first) else np.zeros(0) for c in SIDES}
    r = pa.StructArray.from_arrays([pa.array(ends_of[c], pa.float64(), from_pandas=True) for c in SIDES], names=list(SIDES))
    rows = pa.StructArray.from_arrays([joined, r], names=["text", "r"])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(page[first], minlength=len(sizes)))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def word_blocks(pages: DataFrame) -> DataFrame:
    """``blocks`` from a decoder's words: those that follow each other to the right on one height are a line. A projection of the pages, in linear time."""
    words = F.transform("words", lambda w: F.struct(w["text"].alias("text"), *[w[c].cast("double").alias(c) for c in SIDES]))
    return pages.select("doc_id", "page_num", F.posexplode(_blocks(words)).alias("block_no", "b")).select("doc_id", "page_num", "block_no", "b.text", "b.r")


def _levels(clicks: DataFrame, found: DataFrame) -> DataFrame:
    """Clicks with the blocks of their page, their distance and the least level that each satisfies."""
    rows = clicks.join(found, ["doc_id", "page_num"])
    dx, dy = F.col("x") - (F.col("r.x0") + F.col("r.x1")) / 2, F.col("y") - geo.centre_y(F.col("r"))
    rows = rows.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    some = tx.strip(F.col("text")) != ""
    under = F.col("text").rlike(LINE) & (F.col("dist") < UNDERLINE + 1)
    level = F.when(some & (F.col("dist") <= NEAR), 1).when(some & (F.abs(dy) <= ROW), 2).when(some & (F.col("dist") <= FAR), 3).when(under, 4)
    return rows.withColumn("level", level).withColumn("under", under)


def anchors_from_clicks(clicks: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per click (click_id, doc_id, page_num, x, y): its anchor, or nulls where nothing is near."""
    best = _levels(clicks, found).where("level is not null").groupBy("click_id").agg(F.min(F.struct("level", "dist", "block_no", "text", "r")).alias("b"))
    n = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    rows = clicks.join(best, "click_id", "left").join(n, "doc_id", "left").join(pages.select("doc_id", "page_num", F.col("text").alias("page_text")), ["doc_id", "page_num"], "left")
    rows = rows.withColumn("p", geo.position(F.col("b.r"), F.col("x"), F.col("y")))
    text = F.substring(tx.strip(F.col("b.text")), 1, 120)
    start = tx.escaped(F.substring(text, 1, 60))
    where = F.col("p.position")
    pattern = (
        F.when(F.col("b.level") == 4, LINE).when(where.isin("right", "on"), F.concat(start, F.lit(r"\s*" + LINE))).when(where == "left", F.concat(F.lit(LINE + r"\s*"), start))
        .when(where == "below", F.concat(start, F.lit(r"[\s\S]{0,60}" + LINE))).otherwise(F.concat(F.lit(LINE + r"[\s\S]{0,60}"), start))
    )
    whole = tx.strip(F.col("b.text"))
    at = F.position(whole, F.col("page_text"))
    found_text = (whole != "") & (at > 0)
    line = lambda c: F.translate(c, "\n", " ")
    before = F.when(found_text, line(F.substr("page_text", F.greatest(F.lit(1), at - 50), F.least(at - 1, F.lit(50))))).otherwise("")
    after = F.when(found_text, line(F.substr("page_text", at + F.length(whole), F.lit(50)))).otherwise("")
    sign = geo.signature_box(F.col("b.r"), where, F.col("p.offset"))
    out = {
        "anchor_level": F.col("b.level"), "anchor_type": F.when(F.col("b.level") == 4, "underline_line").otherwise("text_proximity"), "anchor_text": text, "position": where, "offset_pt": F.col("p.offset"),
        "generated_pattern": pattern, "context_before": before, "context_after": after, "page_hint": page_hint(F.col("page_num"), F.col("n")), "x0": sign["x0"], "y0": sign["y0"], "x1": sign["x1"], "y1": sign["y1"],
    }
    return rows.select("click_id", *[F.when(F.col("b").isNotNull(), c).alias(k) for k, c in out.items()])


def has_anchor(clicks: DataFrame, found: DataFrame) -> DataFrame:
    """(click_id, has_anchor): whether text is close by or an underline is near."""
    close = _levels(clicks, found).groupBy("click_id").agg(F.max((F.coalesce(F.col("level") == 1, F.lit(False))) | F.col("under")).alias("has_anchor"))
    return clicks.select("click_id").join(close, "click_id", "left").select("click_id", F.coalesce("has_anchor", F.lit(False)).alias("has_anchor"))
