"""The template registry as tables: listing, upsert, archive, versions, anchors, usage counters, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(templates: DataFrame, language: str | None = None) -> DataFrame:
    """Templates of a language (exact), or all; partitioned storage prunes on it."""
    return templates if language is None else templates.where(F.col("language") == language)


def loaded(templates: DataFrame, template_id: str) -> DataFrame:
    return templates.where(F.col("template_id") == template_id)


def upserted(templates: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after saving ``new`` rows: a row with the same id is replaced."""
    return templates.join(new.select("template_id"), "template_id", "left_anti").unionByName(new)


def deleted(templates: DataFrame, ids: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(registry, archive rows) after deleting ``ids``; unknown ids do nothing."""
    gone = templates.join(ids.select("template_id").distinct(), "template_id", "left_semi")
    archive = gone.withColumn("archive_path", F.concat(F.lit("templates/_archive/"), F.col("template_id"), F.lit(f"_{stamp}.json")))
    return templates.join(ids.select("template_id"), "template_id", "left_anti"), archive


def template_name(language: Column, stamp: Column, kind: Column) -> Column:
    """Name by rule: stamp, language and the beginning of the document type."""
    name = F.concat(F.lit("pipelineAuto1_"), stamp, F.lit("_"), language)
    return F.when(F.coalesce(kind, F.lit("")) != "", F.concat(name, F.lit("_"), F.replace(F.substring(kind, 1, 20), F.lit(" "), F.lit("_")))).otherwise(name)


def next_version(wanted: DataFrame, templates: DataFrame) -> DataFrame:
    """The first free name _v2, _v3 ... of each wanted template (template_id, name, language).

    The taken version numbers of a base name are few; the least number from 2 on that is missing follows from
    their order: the first k whose k-th smallest number is not k + 1.
    """
    base = lambda c: F.regexp_replace(c, r"_v[0-9]+$", "")
    taken = templates.select("language", base("name").alias("base"), F.regexp_extract("name", r"_v([1-9][0-9]*)$", 1).try_cast("long").alias("v")).where("v >= 2").distinct()
    place = Window.partitionBy("language", "base").orderBy("v")
    run = taken.withColumn("k", F.row_number().over(place)).where("v = k + 1").groupBy("language", "base").agg((F.max("v") + 1).alias("next"))
    rows = wanted.withColumn("base", base("name")).join(run, ["language", "base"], "left")
    return rows.select("template_id", F.concat("base", F.lit("_v"), F.coalesce("next", F.lit(2)).cast("string")).alias("new_name"))


def added_anchors(anchors: DataFrame, new: DataFrame) -> DataFrame:
    """Anchors (template_id, pos, anchor_id, ...) after adding new ones whose id the template lacks, each id once.

    Null ids count as one id. New anchors follow the old ones in their own order.
    """
    first = Window.partitionBy("template_id", "anchor_id").orderBy("pos")
    once = new.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    have = anchors.select(F.col("template_id").alias("t"), F.col("anchor_id").alias("a"))
    fresh = once.join(have, (F.col("template_id") == F.col("t")) & F.col("anchor_id").eqNullSafe(F.col("a")), "left_anti")
    both = anchors.withColumn("late", F.lit(0)).unionByName(fresh.withColumn("late", F.lit(1)))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("template_id").orderBy("late", "pos")) - 1).drop("late")


def new_version(templates: DataFrame, wanted: DataFrame, created_at: str) -> DataFrame:
    """Rows for new versions of the ``wanted`` templates (template_id): the next free name, the given date, no usage yet.

    The new id is the old one with the version's suffix; everything else is the old row's. Unknown ids give no row.
    """
    old = templates.join(wanted.select("template_id").distinct(), "template_id", "left_semi")
    named = old.join(next_version(old, templates), "template_id")
    fresh = {"name": F.col("new_name"), "template_id": F.concat("template_id", F.lit("_"), F.regexp_extract("new_name", "_(v[0-9]+)$", 1)), "created_at": F.lit(created_at)}
    fresh |= {c: F.lit(0).cast(templates.schema[c].dataType) for c in ("times_applied", "times_confirmed", "times_rejected") if c in templates.columns}
    fresh |= {c: F.lit(None).cast(templates.schema[c].dataType) for c in ("last_used",) if c in templates.columns}
    return named.select(*[(fresh[c] if c in fresh else F.col(c)).alias(c) for c in templates.columns])


def counted(events: DataFrame) -> DataFrame:
    """Counters of the templates that events (template_id, event, ts) name; unknown events and null ids do nothing."""
    n = lambda e: F.count_if(F.col("event") == e)
    named = events.where("template_id is not null")
    return named.groupBy("template_id").agg(n("applied").alias("times_applied"), n("confirmed").alias("times_confirmed"), n("rejected").alias("times_rejected"), F.max(F.when(F.col("event") == "applied", F.col("ts"))).alias("last_used"))


def with_counts(templates: DataFrame, counts: DataFrame) -> DataFrame:
    """Every template with its counters, 0 where there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return templates.select("template_id").join(counts, "template_id", "left").select("template_id", zero("times_applied"), zero("times_confirmed"), zero("times_rejected"), "last_used")


def usage(templates: DataFrame, events: DataFrame) -> DataFrame:
    """Counters per template from its events (template_id, event, ts); unknown events do nothing."""
    return with_counts(templates, counted(events))


def aliases_of(aliases: Column, language: Column) -> Column:
    """Values of array<struct<language, value>> for a language; all of them where it has none. Blank ones go."""
    full = F.filter(aliases, lambda a: F.trim(a["value"]) != "")
    own = F.filter(full, lambda a: a["language"] == F.lower(F.substring(language, 1, 2)))
    return F.transform(F.when(F.size(own) > 0, own).otherwise(full), lambda a: a["value"])


def masked_key(key: Column) -> Column:
    """A key for display: its first three parts, or eight characters."""
    parts = F.split(key, "-")
    seen = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "-")).otherwise(F.substring(key, 1, 8))
    return F.when(F.coalesce(key, F.lit("")) == "", "").otherwise(F.concat(seen, F.lit("-***")))


def ink_confidence(coverage: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Confidence that an image is a signature, from its measures: struct<confidence, warnings>."""
    dense, narrow, whole = coverage > 0.25, (h > 0) & (w / h < 1.2), (w > 0.85 * image_w) & (h > 0.85 * image_h)
    value = 1.0 - F.when(dense, 0.4).otherwise(0.0) - F.when(narrow, 0.2).otherwise(0.0) - F.when(whole, 0.5).otherwise(0.0)
    names = F.filter(F.array(F.when(dense, "dense"), F.when(narrow, "narrow"), F.when(whole, "whole")), lambda x: x.isNotNull())
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("confidence"), names.alias("warnings"))
