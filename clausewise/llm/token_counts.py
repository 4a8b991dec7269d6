"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Every text is encoded whole; only its length is kept, and lengths are counted per batch before the
shuffle. The histogram has one row per distinct length, and running sums over it answer, for every
context limit, totals, quantiles and what truncation at that limit keeps. The sums are built in two
levels (blocks of lengths, then lengths in a block), so no task holds the histogram.

Runs of 64 white-space characters and more are handed to the encoder as the pieces that the word pattern cuts them into, as its
matcher takes the square of their length and would run out of stack on the longest; nothing is skipped.

Defined results. Null and empty texts have 0 tokens. An empty table has no rows. Special tokens'
strings in a text are ordinary text. Very long texts are encoded whole. Equal lengths are one row; repeated
rows count each time. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public word pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024
#: White space as the pattern has it, in runs that are cut before the encoder.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{64,}")


def encoder(lines: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length(enc, text: str, pattern: str = PATTERN) -> int:
    """Number of tokens of ``text``.

    A run of white space is one piece of ``PATTERN`` but for its last character, which belongs to what follows
    (all of it at the end of a text). Texts are cut there where a run is long.
    """
    n, done = 0, 0
    for run in BLANK.finditer(text) if pattern == PATTERN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(enc.encode_ordinary(text[done : run.start()])) + len(enc._encode_single_piece(text[run.start() : end].encode("utf-8")))
        done = end
    return n + len(enc.encode_ordinary(text[done:] if done else text))


def _lengths(vocabulary, pattern):
    def job(batches):
        enc = encoder(vocabulary.value, pattern)
        for batch in batches:
            column, found = batch.column("text"), {}
            for i in range(len(column)):
                n = length(enc, column[i].as_py() or "", pattern)
                found[n] = found.get(n, 0) + 1
            if found:
                yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    return job


def length_histogram(docs: DataFrame, text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many texts have each encoded length. ``ranks`` is read by the driver."""
    with open(ranks, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    return (
        docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_lengths(vocabulary, pattern), "n_tokens long, n long")
        .groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))
    )


def length_profile(histogram: DataFrame) -> DataFrame:
    """For each length as context limit: documents and tokens from it on, share of documents up to it, tokens kept by truncation."""
    # Written once: the rows and the sums over blocks both read it, and the texts are encoded once.
    histogram = cut(histogram, "lengths")
    rows = histogram.withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    later = sums.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    rows = rows.join(later, "block").select(
        "n_tokens", "n_docs", "d_all", "t_all", (F.sum("n_docs").over(inside) + F.col("d_after")).alias("docs_from"), (F.sum("tokens").over(inside) + F.col("t_after")).alias("tokens_from")
    )
    kept = F.col("t_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return rows.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", ((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all")).alias("share_up_to"), kept.alias("kept_tokens"), F.col("t_all").alias("all_tokens")
    )


def quantile(profile: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share ``q`` of all documents does not exceed."""
    return profile.where(F.col("share_up_to") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def kept_at(profile: DataFrame, limit: int) -> DataFrame:
    """One row: tokens that remain when every document is cut at ``limit`` tokens."""
    over = profile.where(F.col("n_tokens") >= limit)
    under = profile.where(F.col("n_tokens") < limit)
    return over.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).crossJoin(under.agg(F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("t"))).select((F.col("n") * limit + F.col("t")).alias("kept_tokens"))
