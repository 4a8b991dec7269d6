"""Finding the places to sign: pattern search with filters, suppression, template anchors, conversions.

A page is one row with its text and its layout (a decoder's words with boxes, or the fixtures' monospaced lines); matches, rectangles and suppression are array expressions
of that row, so a search is a projection of the pages. Only match ids need the document's pages in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import patterns as pt
from ..functions import text as tx

#: Words of a page in reading order, as decoders give them.
WORDS = "array<struct<text: string, x0: double, y0: double, x1: double, y1: double>>"
NONE = "array<struct<pattern_idx: int, start: int, stop: int, matched: string>>"
#: A pattern that matches nowhere.
NEVER = "(?!)"


@dataclass(frozen=True)
class Party:
    """The side whose places are looked for."""

    name: str
    patterns: tuple[str, ...]
    aliases: tuple[str, ...] = ()
    signer: str = ""
    other_aliases: tuple[str, ...] = field(default=())


def forward(pattern: str) -> bool:
    """Not a backward pattern over several lines (line first, then any text)."""
    bare = re.sub(r"^\(\?:", "", pattern)
    backward = bare.startswith(("_", "\\.", "."))
    return not (backward and ("\\s\\S" in pattern or "\\S\\s" in pattern))


def admissible(pattern: str) -> bool:
    """``forward``, and one that can run."""
    return forward(pattern) and pt.valid(pattern)


def party_tokens(party: Party, spark: SparkSession) -> Column:
    """Identifying words of the party's aliases and signer, each once, as a literal.

    The rule is folded over one local row, so plans carry the words and not the rule.
    """
    names = [*party.aliases, *([party.signer] if party.signer else [])]
    if not names:
        return F.array().cast("array<string>")
    rule = tx.distinct_by_case(F.concat(*[tx.alias_tokens(F.lit(n)) for n in names]))
    words = spark.sql("SELECT 1").select(rule.alias("words")).first()["words"]
    return F.array(*map(F.lit, words)).cast("array<string>")


def with_layout(pages: DataFrame) -> DataFrame:
    """Adds what a page's layout is searched by: ``word_index`` where pages hold a decoder's words, else the monospaced ``page_lines``."""
    if "words" in pages.columns:
        return pages.withColumn("word_index", geo.word_index(F.coalesce("words", F.array().cast(WORDS)))).drop("words")
    parts = F.split("text", "\n")
    return pages.withColumn("page_lines", F.slice(parts, F.lit(1), F.size(parts) - 1))


def layout(pages: DataFrame) -> str:
    """The column that ``with_layout`` adds."""
    return "word_index" if "word_index" in pages.columns else "page_lines"


def finder(pages: DataFrame):
    """The search on the pages' layout: from a text to its rectangles."""
    return geo.on_words(F.col("word_index")) if layout(pages) == "word_index" else geo.on_lines(F.col("page_lines"))


def pattern_spans(text: Column, patterns) -> Column:
    """Matches of all patterns (index, form for Java), pattern by pattern."""
    marked = lambda i: lambda s: F.struct(F.lit(i).alias("pattern_idx"), s["start"].alias("start"), s["stop"].alias("stop"), s["matched"].alias("matched"))
    found = [F.transform(tx.spans(text, p), marked(i)) for i, p in patterns]
    return F.concat(*found) if found else F.array().cast(NONE)


def candidates(rows: DataFrame, spans: Column, tokens: Column, others: Column) -> DataFrame:
    """Adds ``found``: of the ``spans``, those that hold a line to sign on, name no post and no other party.

    Of equal spans the first pattern's counts, before other parties are looked at. Pages without a line to
    sign on go first, by one cheap test. Every step is a column of its own and none is filtered on, as a
    filter would be pushed below the column and compute it again.
    """
    text = F.col("text")
    before = lambda s: F.substr(text, F.greatest(F.lit(0), s["start"] - 40) + 1, F.least(s["start"], F.lit(40)))
    rows = rows.where(tx.signature_line(text)).withColumn("_all", spans)
    rows = rows.withColumn("_kept", F.filter("_all", lambda s: tx.signature_line(s["matched"]) & ~tx.in_role_phrase(before(s), s["matched"], tokens)))
    rows = rows.withColumn("_first", F.filter("_kept", lambda s, i: ~F.exists(F.slice("_kept", F.lit(1), i), lambda e: (e["start"] == s["start"]) & (e["stop"] == s["stop"]))))
    return rows.withColumn("found", F.filter("_first", lambda s: ~F.exists(others, lambda a: F.contains(F.lower(s["matched"]), a)))).drop("_all", "_kept", "_first")


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """Adds ``raw``: the candidates of ``found`` with their rectangles on a line to sign on, numbered through the document (and each value of ``by``)."""
    find = finder(rows)
    rows = rows.withColumn("lines", geo.line_rects(find))

    def boxes(s):
        good = F.filter(geo.text_rects(find, s["matched"]), lambda r: (r["y1"] - r["y0"] <= geo.MAX_HEIGHT) & F.exists("lines", lambda u: geo.touches(u, r)))
        return F.transform(good, lambda r: F.struct(s.alias("s"), r.alias("r")))

    rows = rows.withColumn("raw", F.flatten(F.transform("found", boxes)))
    before = Window.partitionBy("doc_id", *by).orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.size("raw")).over(before), F.lit(0)))
    numbered = F.transform("raw", lambda m, i: F.struct((F.col("before") + i + 1).cast("int").alias("seq"), m["s"].alias("s"), m["r"].alias("r")))
    return rows.withColumn("raw", numbered).drop("lines", "before", "found")


def raw_matches(pages: DataFrame, party: Party) -> DataFrame:
    """Per page the matches of one party before suppression."""
    others = F.array(*[F.lit(a.strip().lower()) for a in party.other_aliases if len(a.strip()) >= 3]).cast("array<string>")
    spans = pattern_spans(F.col("text"), [(i, own) for i, p in enumerate(party.patterns) if admissible(p) and (own := pt.compiled(pages.sparkSession, p))])
    rows = candidates(with_layout(pages), spans, party_tokens(party, pages.sparkSession), others)
    return placed(rows).select("doc_id", "page_num", "text", "raw")


def match_name(prefix: str, number: Column) -> Column:
    """A match's id: its number with three digits at least."""
    n = number.cast("string")
    return F.concat(F.lit(f"{prefix}_"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")))


def listed(rows: DataFrame, column: str, party: Party, prefix: str = "sig") -> DataFrame:
    """One row per match of an array column."""
    patterns = F.array(*map(F.lit, party.patterns))
    m = rows.select("doc_id", "page_num", "text", F.explode(column).alias("m"))
    return m.select(
        "doc_id", match_name(prefix, F.col("m.seq")).alias("match_id"), "page_num",
        F.col("m.r.x0").alias("x0"), F.col("m.r.y0").alias("y0"), F.col("m.r.x1").alias("x1"), F.col("m.r.y1").alias("y1"),
        tx.snippet(F.col("text"), F.col("m.s.start"), F.col("m.s.stop")).alias("context"), F.get(patterns, F.col("m.s.pattern_idx")).alias("pattern"),
    )


def find_signatures(pages: DataFrame, party: Party) -> DataFrame:
    """The places where ``party`` signs: (doc_id, match_id, page_num, box, context, pattern)."""
    rows = raw_matches(pages, party).withColumn("kept", geo.one_per_row(geo.without_overlaps(F.col("raw"))))
    return listed(rows, "kept", party)


def find_signatures_smart(pages: DataFrame, party: Party, more_patterns: tuple[str, ...] = ()) -> DataFrame:
    """``find_signatures``; documents without a match are searched again with more patterns. Adds mode."""
    found = find_signatures(pages, party).withColumn("mode", F.lit("regex"))
    if not more_patterns:
        return found
    wider = Party(party.name, tuple(dict.fromkeys((*party.patterns, *more_patterns))), party.aliases, party.signer, party.other_aliases)
    rest = pages.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(find_signatures(rest, wider).withColumn("mode", F.lit("llm_fallback")))


def hinted_pages(hint: Column, n: Column) -> Column:
    """Page numbers that an anchor's hint names; negative ones count from the end when they are read."""
    number = hint.try_cast("int")
    every = F.sequence(F.lit(0), n - 1)
    return F.when(hint == "first", F.array(F.lit(0))).when(hint == "last", F.array(n - 1)).when(hint == "any", every).when(number.isNotNull(), F.array(number)).otherwise(every)


def signing_page(hint: Column) -> Column:
    """The page on which an anchor is signed: first 0, last -1, a number, else 0."""
    return F.when(hint == "first", 0).when(hint == "last", -1).otherwise(F.coalesce(hint.try_cast("int"), F.lit(0)))


def page_hint(page: Column, n: Column) -> Column:
    """The hint that names a page: first, last or its number."""
    return F.when(page == 0, "first").when(page == n - 1, "last").otherwise(page.cast("string"))


def located(pages: DataFrame, locations: DataFrame) -> DataFrame:
    """Places that a model named (doc_id, pos, page from 1, text_marker, context), with rectangles and confidence 0.7."""
    pages = with_layout(pages)
    rows = locations.where("text_marker <> ''").withColumn("page_num", F.col("page") - 1).join(pages.select("doc_id", "page_num", layout(pages)), ["doc_id", "page_num"])
    rows = rows.select("*", F.posexplode(geo.marker_rects(finder(rows), F.col("text_marker"))).alias("rect_order", "r"))
    name = match_name("llm", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "rect_order")))
    return rows.select("doc_id", name.alias("match_id"), "page_num", F.col("r.x0").alias("x0"), F.col("r.y0").alias("y0"), F.col("r.x1").alias("x1"), F.col("r.y1").alias("y1"), F.substring(F.coalesce("context", "text_marker"), 1, 100).alias("context"), F.lit("llm_fallback").alias("pattern"), F.lit(0.7).alias("confidence"))


def apply_anchors(pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """A template's anchors on a document: (doc_id, match_id, page_num, box, context, pattern).

    anchors: doc_id, anchor_idx, pattern, page_hint, context_before, anchor_text, bbox. An anchor without any match (none is looked for
    where its pattern is null or cannot run) falls back to its own box on its first hinted page, if that exists.
    """
    anchors = anchors.withColumn("_regex", pt.java(F.col("pattern")))
    pages = with_layout(pages)
    count = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    asked = anchors.join(count, "doc_id").withColumn("hinted", hinted_pages(F.col("page_hint"), F.col("n")))
    on_page = asked.select("*", F.posexplode("hinted").alias("page_order", "page")).withColumn("page_num", F.when(F.col("page") < 0, F.col("n") + F.col("page")).otherwise(F.col("page")))
    rows = on_page.join(pages.select("doc_id", "page_num", "text", layout(pages)), ["doc_id", "page_num"]).where("_regex is not null")
    rows = rows.withColumn("s", F.explode(tx.spans(F.col("text"), F.col("_regex"))))
    wanted = F.lower(tx.strip(tx.squeeze(F.col("context_before"))))
    size = F.length("context_before") + 40
    preceding = F.lower(tx.squeeze(F.substr(F.col("text"), F.greatest(F.lit(0), F.col("s.start") - size) + 1, F.least(F.col("s.start"), size))))
    rows = rows.where((wanted == "") | preceding.contains(wanted))
    rows = rows.select("*", F.posexplode(geo.text_rects(finder(rows), F.col("s.matched"))).alias("rect_order", "r")).where(F.col("r.y1") - F.col("r.y0") <= geo.MAX_HEIGHT)
    hits = rows.select("doc_id", "anchor_idx", "page_order", F.col("s.start").alias("start"), "rect_order", F.col("page").alias("page_num"), "r", tx.snippet(F.col("text"), F.col("s.start"), F.col("s.stop")).alias("context"), "pattern")
    missed = asked.join(hits.select("doc_id", "anchor_idx").distinct(), ["doc_id", "anchor_idx"], "left_anti").withColumn("page_num", F.get("hinted", F.lit(0))).where("page_num between 0 and n - 1 and bbox is not null")
    own = missed.select(
        "doc_id", "anchor_idx", F.lit(0).alias("page_order"), F.lit(0).alias("start"), F.lit(0).alias("rect_order"), "page_num", F.col("bbox").alias("r"), F.substring("anchor_text", 1, 80).alias("context"),
        F.concat(F.lit("[bbox_fallback] "), F.coalesce("pattern", F.lit(""))).alias("pattern"),
    )
    order = Window.partitionBy("doc_id").orderBy("anchor_idx", "page_order", "start", "rect_order")
    found = hits.unionByName(own)
    return found.select("doc_id", match_name("tpl", F.row_number().over(order)).alias("match_id"), "page_num", F.col("r.x0").alias("x0"), F.col("r.y0").alias("y0"), F.col("r.x1").alias("x1"), F.col("r.y1").alias("y1"), "context", "pattern")


def matches_to_anchors(matches: DataFrame) -> DataFrame:
    """Matches as anchors: the context is the text, and what stands before and after the pattern in it is kept.

    A pattern that cannot run (a box's note in front of it can do that) finds nothing in the context.
    """
    matches = matches.withColumn("_regex", F.coalesce(pt.java(F.col("pattern")), F.lit(NEVER)))
    pattern = F.col("_regex")
    hit = F.get(tx.find_all(F.col("context"), pattern), F.lit(0))
    parts = F.split("context", pattern, 2)
    before, after = F.when(hit.isNotNull(), F.get(parts, F.lit(0))).otherwise(""), F.when(hit.isNotNull(), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).otherwise("")
    return matches.select(
        "doc_id", "match_id", F.substring(tx.strip(F.col("context")), 1, 120).alias("anchor_text"), F.col("pattern").alias("generated_pattern"), F.right(before, F.lit(50)).alias("context_before"),
        F.substring(after, 1, 50).alias("context_after"), F.col("page_num").cast("string").alias("page_hint"), F.lit("auto_regex").alias("added_by"), "x0", "y0", "x1", "y1",
    )


def count_patterns(pages: DataFrame, patterns) -> DataFrame:
    """Per document and pattern the number of matches (empty ones by Java's rule), -1 for a pattern that cannot run."""
    java = [pt.compiled(pages.sparkSession, p, filled=False) for p in patterns]
    counts = [F.lit(-1).cast("long").alias(f"c{i}") if p is None else F.sum(F.regexp_count("text", F.lit(p))).alias(f"c{i}") for i, p in enumerate(java)]
    rows = pages.groupBy("doc_id").agg(*counts)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pattern_idx"), F.col(f"c{i}").cast("long").alias("n")) for i in range(len(patterns))]))
    return rows.select("doc_id", each.alias("c")).select("doc_id", "c.pattern_idx", "c.n")
