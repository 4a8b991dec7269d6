"""Queries in SQL text over the exported functions, with the oracles of the DataFrame queries that they repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import exports
from ..sources.contracts import contracts, pages
from . import matching, searching


def _views(spark: SparkSession, sf_dir: str) -> None:
    exports.register(spark)
    pages(contracts(spark, sf_dir)).createOrReplaceTempView("contract_pages")


def sql_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(
        "SELECT doc_id, page_num, cast(s.start AS BIGINT) AS start, length(s.matched) AS size, signature_line(s.matched) AS is_line FROM contract_pages, LATERAL signature_spans(text, r'[_\\.]{3,}') AS s WHERE text RLIKE r'[_.]{3}'"
    )


def sql_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the fixtures' party in Java's form, counted by SQL on all pages."""
    _views(spark, sf_dir)
    values = ", ".join("(r'%s')" % p for p in searching.PARTY.patterns[:2] + searching.PARTY.patterns[5:7])
    return spark.sql(
        f"WITH p AS (SELECT pattern, java_pattern(pattern) AS java FROM VALUES {values} AS v(pattern)) SELECT doc_id, pattern, sum(regexp_count(text, java)) AS n FROM contract_pages JOIN p ON contains(lower(text), lower(required_text(pattern))) GROUP BY doc_id, pattern HAVING n > 0"
    )


_chosen = [p for p in searching.PARTY.patterns[:2] + searching.PARTY.patterns[5:7]]
SQL_PATTERNS = searching.PAGE_LINES + " SELECT doc_id, pattern, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, {searching._sql(p)} AS pattern, len(regexp_extract_all(text, {searching._sql('(?i)' + p)})) AS n FROM plines" for p in _chosen
) + ") GROUP BY doc_id, pattern HAVING sum(n) > 0"


def sql_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint's header hash by SQL: of the header page that the fingerprint names."""
    from ..operators import fingerprint as fp

    _views(spark, sf_dir)
    fp.header_page(pages(contracts(spark, sf_dir))).createOrReplaceTempView("header_pages")
    return spark.sql("SELECT p.doc_id, simhash64(text) AS simhash FROM contract_pages p JOIN header_pages h ON p.doc_id = h.doc_id AND p.page_num = h.header_page")


QUERIES = {f.__name__: f for f in (sql_spans, sql_patterns, sql_simhash)}
SQL = {"sql_spans": searching.SIG_SPANS, "sql_patterns": SQL_PATTERNS, "sql_simhash": matching.FP_SIMHASH}
