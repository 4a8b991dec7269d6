"""The package's rules as functions and table functions of SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as pt

#: Functions that SQL can say itself.
SQL = {
    "signature_line(t STRING) RETURNS BOOLEAN": r"t RLIKE r'_{3,}|\.{5,}'",
    "simhash_similarity(a BIGINT, b BIGINT) RETURNS DOUBLE": "coalesce(greatest(0.0D, 1.0D - bit_count(a ^ b) / 64.0D), 0.0D)",
    "page_similarity(n BIGINT, m BIGINT) RETURNS DOUBLE": "CASE WHEN greatest(n, m) = 0 THEN if(n = 0 AND m = 0, 1.0D, 0.0D) ELSE 1.0D - abs(n - m) / greatest(n, m) END",
    "masked_key(k STRING) RETURNS STRING": "CASE WHEN coalesce(k, '') = '' THEN '' ELSE concat(if(size(split(k, '-')) >= 3, array_join(slice(split(k, '-'), 1, 3), '-'), substring(k, 1, 8)), '-***') END",
}
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("matched", T.StringType())])


class Spans:
    """signature_spans(text, pattern): the matches of a Python pattern that are not empty, letter case apart; none where it does not compile."""

    def eval(self, text: str, pattern: str):
        if text is not None and pattern is not None and pt.valid(pattern):
            for m in re.finditer(pattern, text, re.IGNORECASE):
                if m.group():
                    yield m.start(), m.end(), m.group()


@F.pandas_udf(T.StringType())
def java_pattern(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else pt.translated(p)[0])


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    from ..operators.fingerprint import _simhash

    return _simhash.func(texts.map(lambda t: None if t is None else re.sub(r"[^\w]", "", t.lower())))


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session; returns their names."""
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, own in (("java_pattern", java_pattern), ("required_text", pt.required_text), ("simhash64", simhash64)):
        spark.udf.register(name, own)
    spark.udtf.register("signature_spans", F.udtf(Spans, returnType=SPAN))
    return [*(h.partition("(")[0] for h in SQL), "java_pattern", "required_text", "simhash64", "signature_spans"]
