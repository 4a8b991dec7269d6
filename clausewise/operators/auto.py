"""The automatic flow: our side, patterns and places to sign of each document, from a model's replies.

Every document has its own patterns. They are translated for Java row by row (``functions/patterns.py``); one that cannot run is left out and ends nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import patterns as pt
from ..functions import text as tx
from . import replies as rp
from . import search as se

#: Errors of the steps.
ERRORS = {
    "no JSON": "Шаг 3: LLM не ответил или невалидный JSON.", "side not found": "Шаг 3: Наша сторона не найдена в шапке договора.",
    "no patterns": "Шаг 4: LLM не вернул паттерны.", "none valid": "Шаг 4: Не удалось сгенерировать валидные паттерны.",
    "none found": "Шаг 5: Паттерны сгенерированы, но мест подписи не найдено.",
}


def valid_patterns(patterns) -> Column:
    """The patterns that can run."""
    patterns = F.col(patterns) if isinstance(patterns, str) else patterns
    return tx.let(F.struct(patterns.alias("p"), pt.java_each(patterns).alias("j")), lambda b: F.filter(b["p"], lambda p, i: F.get(b["j"], i).isNotNull()))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def admissible(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda ps: [se.admissible(p) for p in ps])


def _spans(text: Column, java: Column, allowed: Column) -> Column:
    """Matches of each document's own patterns (forms for Java), pattern by pattern."""
    each = lambda p, i: F.transform(tx.spans(text, p), lambda s: F.struct(i.alias("pattern_idx"), s["start"].alias("start"), s["stop"].alias("stop"), s["matched"].alias("matched")))
    return F.flatten(F.transform(java, lambda p, i: F.when(F.get(allowed, i) & p.isNotNull(), each(F.coalesce(p, F.lit(se.NEVER)), i)).otherwise(F.array().cast(se.NONE))))


def sides(replies: DataFrame) -> DataFrame:
    """(doc_id, side, patterns, error) from replies (doc_id, step, raw) to the steps step3 and step4."""
    by = replies.groupBy("doc_id").agg(*[F.max(F.when(F.col("step") == s, F.col("raw"))).alias(s) for s in ("step3", "step4")])
    rows = by.withColumn("side", rp.our_side(F.col("step3"))).withColumn("_given", rp.reply_patterns(F.col("step4"))).withColumn("patterns", valid_patterns("_given")).drop("_given")
    error = F.coalesce(F.col("side.error"), F.when(rp.json_object(F.col("step4")).isNull(), "no patterns"), F.when(F.size("patterns") == 0, "none valid"))
    return rows.select("doc_id", "side", "patterns", error.alias("error"))


def matches(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Places to sign of the documents without an error, each with its own party and patterns."""
    side = F.col("side")
    empty = F.array().cast("array<string>")
    name = lambda c: F.when(tx.strip(c) != "", F.array(tx.strip(c))).otherwise(empty)
    aliases = F.concat(name(side["legal_entity"]), side["roles"], name(side["signer"]))
    known = found.where("error is null").withColumn("tokens", tx.distinct_by_case(F.flatten(F.transform(aliases, tx.alias_tokens)))).withColumn("others", F.transform(rp.other_aliases(side), lambda a: F.lower(tx.strip(a)))).withColumn("allowed", admissible("patterns")).withColumn("java", pt.java_each(F.col("patterns")))
    rows = se.with_layout(pages).join(known.select("doc_id", "patterns", "java", "allowed", "tokens", "others"), "doc_id")
    rows = se.candidates(rows, _spans(F.col("text"), F.col("java"), F.col("allowed")), F.col("tokens"), F.col("others"))
    rows = se.placed(rows).withColumn("kept", geo.one_per_row(geo.without_overlaps(F.col("raw"))))
    m = rows.select("doc_id", "page_num", "patterns", "text", F.explode("kept").alias("m"))
    return m.select("doc_id", se.match_name("sig", F.col("m.seq")).alias("match_id"), "page_num", F.col("m.seq").alias("seq"), *[F.col(f"m.r.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], F.get("patterns", F.col("m.s.pattern_idx")).alias("pattern"), tx.snippet(F.col("text"), F.col("m.s.start"), F.col("m.s.stop")).alias("context"))


def results(found: DataFrame, places: DataFrame) -> DataFrame:
    """One row per document: ok, the first failing step's error, counts of patterns and places."""
    n = places.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = found.join(n, "doc_id", "left").withColumn("e", F.coalesce("error", F.when(F.col("n").isNull(), "none found")))
    said = F.coalesce(*[F.when(F.col("e") == k, v) for k, v in ERRORS.items()])
    return rows.select("doc_id", F.col("e").isNull().alias("ok"), said.alias("error"), F.when(F.col("error").isNull(), F.size("patterns")).alias("n_patterns"), F.coalesce("n", F.lit(0)).alias("n_matches"))
