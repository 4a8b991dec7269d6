"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight that changes over the training run, given by knots (time in [0, 1], weight)
and linear between them. Per interval between knots the weights are integrated; a source's share of the
interval's words is its integral over the sum of all. Cumulated, this is the source's demand over time.
The whole run takes as many words as there are; a source gives at most ``max_repeats`` times its own words,
and what it cannot give is reshared among the others by weight (water-filling by one sort over the
sources). Demand curves are scaled to those targets.

Within a source, documents stand in the order of a hash of their id, pass after pass. A document's place
among its source's words is inverted through the demand curve: the time at which the source's demand
reaches that place is the training position. Sorting by range of position gives the training order.

Scale. Sizes are written slim, with a number for each row; what travels with a document is joined by that number and never goes through a
window. Prefix sums come in two levels (sums of hash buckets per source, as many as the rows need, then within a bucket), so a source with a third of all
rows is dealt over all tasks. Rows of an id that over ``MANY`` rows share (or of none) enter the sums as one entry for each size, and their places within it
are counted per part of the input.

Defined results. A null text has size 0 and is taken 0 times, as is an empty one; a very long one is one large size. Null sources form a source of their own, last
in order. Sources of weight 0 and, in ``by_rule``, tables without words have target 0; an empty table has no rows. Rows that repeat an id
each count; those that also agree in size are interchangeable, and ties in position are ordered by id. The last document that a target reaches is taken in part, so the words taken are the
target rounded down. Clashing columns are no concern: only id, source and text are read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: Rows that a hash bucket is meant for, and rows from which on an id enters the sums by size.
PER_BUCKET, MANY = 50_000, 1_000
#: Bucket sums that are sent to all executors (some 200 bytes each); more are joined by shuffle.
SENT = 100_000
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text):
    """Number of runs outside space and the control spaces; null: 0."""
    marks = F.regexp_replace(text, WORD, "w")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows (id, source, size, hash) that everything else works on; with ``keep`` also doc, all columns in a struct."""
    hashed = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"),
        hashed.alias("hash"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep else []),
    )


def by_rule(slim: DataFrame, weights=(1.0, 2.0, 3.0)) -> DataFrame:
    """A constant schedule (source, t, weight): sources by code point, null last, get the weights in turn."""
    turn = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(turn) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    return slim.select("source").distinct().withColumn("weight", weight).withColumn("t", F.explode(F.array(F.lit(0.0), F.lit(1.0))))


def demand(slim: DataFrame, schedule: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Per source: source_size, target and the knots of its demand curve, array<struct<t, words>>.

    ``schedule`` holds (source, t, weight) with the same times for every source, 0 and 1 among them.
    One row per source passes through single tasks here; documents never do.
    """
    own = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    knots = Window.partitionBy("source").orderBy("t")
    pieces = (
        schedule.select("source", F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("weight"))
        .withColumn("u", F.lead("t").over(knots)).withColumn("w2", F.lead("weight").over(knots)).where("u is not null")
        .withColumn("area", (F.col("weight") + F.col("w2")) / 2 * (F.col("u") - F.col("t")))
    )
    span = Window.partitionBy("t")
    pieces = pieces.withColumn("share", F.coalesce(F.expr("area / nullif(sum(area) over (partition by t), 0)"), F.lit(0.0)) * (F.col("u") - F.col("t")))
    per = pieces.groupBy("source").agg(F.sum("area").alias("weight"), F.array_sort(F.collect_list(F.struct("u", "share"))).alias("steps"), F.sum("share").alias("whole"))
    known = own.join(per, own["source"].eqNullSafe(per["source"]), "left").select(own["source"], "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"), "steps", "whole")
    # Water-filling: sources by the level at which they are full; one is full if the level that the
    # sources not yet passed would reach lies above its own.
    room = F.col("source_size") * max_repeats
    level = F.when(F.col("weight") > 0, room / F.col("weight"))
    fill = Window.orderBy(F.col("weight") <= 0, level, F.col("source").isNull(), "source")
    passed = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    known = (
        known.withColumn("room", room).withColumn("level", level).withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("weight").over(everything))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("room").over(passed), F.lit(0)))
        .withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("weight").over(passed), F.lit(0.0)))
        .withColumn("full", F.coalesce(F.col("level") * F.col("left_w") < F.col("left_words"), F.lit(False)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(everything), F.lit(0)))
        .withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0.0)))
    )
    fair = F.coalesce(F.expr("weight * rest / nullif(rest_w, 0)"), F.lit(0.0))
    known = known.withColumn("target", F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("full"), F.col("room").cast("double")).otherwise(fair))
    curve = F.expr(
        "concat(array(struct(0D as t, 0D as words)), aggregate(steps, cast(array() as array<struct<t: double, sum: double, words: double>>), "
        "(a, x) -> concat(a, array(struct(x.u as t, coalesce(try_element_at(a, -1).sum, 0D) + x.share as sum, "
        "target * (coalesce(try_element_at(a, -1).sum, 0D) + x.share) / whole as words))), a -> transform(a, x -> struct(x.t as t, x.words as words))))"
    )
    return known.withColumn("curve", F.when(F.col("target") > 0, curve)).select("source", "source_size", "target", "curve")


def assign(slim: DataFrame, schedule: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Every row of ``slim`` with source_size, target, taken (words, repeats counted), first_position and copies.

    ``copies`` is array<struct<position: double, words: bigint>>: where in training each pass takes the
    document and how many of its words.
    """
    written = cut(slim.withColumn("row", F.monotonically_increasing_id()), "sizes")  # numbers stay as written
    thin = written.drop("doc")
    plan = demand(thin, schedule, max_repeats)
    digits = min(8, max(2, math.ceil(math.log(max(1, thin.count()) / PER_BUCKET + 1, 16))))
    thin = thin.withColumn("bucket", F.conv(F.substring("hash", 1, digits), 16, 10).cast("long"))
    buckets = thin.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # The bucket table stands once for both lookups.
    b = buckets.join(plan, buckets["source"].eqNullSafe(plan["source"])).select(buckets["source"].alias("s"), F.col("bucket").alias("k"), "before", "source_size", "target", "curve")
    b = cut(b, "buckets")
    sent = lambda df: F.broadcast(df) if df.count() <= SENT else df
    hot = cut(thin.groupBy("hash").count().where(f"count > {MANY}").select("hash"), "hot")
    some = not hot.isEmpty()
    entries = (thin.join(sent(hot), "hash", "left_anti") if some else thin).withColumn("words", F.col("size"))
    if some:
        of_hot = thin.join(sent(hot), "hash", "left_semi")
        same = ("source", "bucket", "hash", "id", "size")
        grouped = of_hot.groupBy(*same).agg(F.sum("size").alias("words")).withColumn("row", F.lit(None).cast("long"))
        entries = entries.unionByName(grouped)
    near = sent(b)
    entries = entries.join(near, entries["source"].eqNullSafe(b["s"]) & (entries["bucket"] == b["k"]))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.withColumn("start", F.col("before") + F.coalesce(F.sum("words").over(inside), F.lit(0))).drop("words")
    if some:
        rows = cut(rows, "starts")
        starts = rows.where("row is null").select(*[F.col(c).alias(f"g_{c}") for c in same], *[c for c in rows.columns if c not in (*same, "row")])
        # A row's place among its equals: equals in earlier parts of the input, and in its own.
        of_hot = of_hot.withColumn("part", F.shiftright("row", 33))
        earlier = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ahead = of_hot.groupBy(*same, "part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        ahead = ahead.select(*[F.col(c).alias(f"p_{c}") for c in (*same, "part")], "ahead")
        placed = of_hot.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "part").orderBy("row")) - 1)
        meet = lambda df, mark, columns: functools.reduce(lambda x, y: x & y, [placed[c].eqNullSafe(df[f"{mark}_{c}"]) for c in columns])
        placed = placed.join(sent(ahead), meet(ahead, "p", (*same, "part"))).join(sent(starts), meet(starts, "g", same))
        placed = placed.withColumn("start", F.col("start") + (F.col("ahead") + F.col("nth")) * F.col("size"))
        rows = rows.where("row is not null").unionByName(placed.select(*rows.columns))
    position = (
        "element_at(transform(filter(sequence(1, size(curve) - 1), i -> curve[i].words > x), i -> curve[i - 1].t + "
        "(x - curve[i - 1].words) / (curve[i].words - curve[i - 1].words) * (curve[i].t - curve[i - 1].t)), 1)"
    )
    taken = "least(size, greatest(0L, cast(floor(target) as bigint) - x))"
    copies = F.expr(
        f"filter(transform(transform(sequence(0, {max_repeats - 1}), p -> start + p * source_size), x -> struct(if({taken} > 0, {position}, null) as position, {taken} as words)), c -> c.words > 0)"
    )
    rows = rows.withColumn("copies", copies).withColumn("taken", F.expr("aggregate(copies, 0L, (a, c) -> a + c.words)"))
    rows = rows.withColumn("first_position", F.expr("try_element_at(copies, 1).position"))
    rows = rows.drop("s", "k", "before", "curve", "start", "bucket", "hash")
    return rows.join(written.select("row", "doc"), "row") if "doc" in written.columns else rows


def mix(slim: DataFrame, schedule: DataFrame, max_repeats: int = 3) -> DataFrame:
    """``assign`` sorted by range of the first position; rows that are not taken come last."""
    order = (F.col("first_position").asc_nulls_last(), F.col("id").asc_nulls_last())
    return assign(slim, schedule, max_repeats).drop("row").repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(slim: DataFrame, schedule: DataFrame, max_repeats: int = 3) -> DataFrame:
    """One row per taken copy, sorted by range of training position: id, position, words (and doc)."""
    each = assign(slim, schedule, max_repeats).where("taken > 0").withColumn("c", F.explode("copies"))
    each = each.select("id", F.col("c.position").alias("position"), F.col("c.words").alias("words"), *[c for c in ("doc",) if c in each.columns])
    return each.repartitionByRange("position", "id").sortWithinPartitions("position", "id")
