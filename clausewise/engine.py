"""The engine's front: analysis of documents against the registry, placements, anchors from clicks, new templates."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import similarity as sim
from .operators import auto, clicks, fingerprint, matcher, placement, registry, search
from .sources import files, scratch, settings, templates
from .sources.files import Catalog
from .sources.llm import LanguageModel

#: What an analysis says of every document.
RESULT = ("doc_id", "traffic_light", "template_id", "score", "explanation", "path", "our_side", "n_matches", "error")
NO_PAGES = "the document has no pages"
BOXES = ("doc_id", "match_id", "page_num", "x0", "y0", "x1", "y1", "context", "pattern")


@dataclass(frozen=True)
class Analysis:
    """results: one row per document (``RESULT``); matches: ``BOXES``; prints: the documents' fingerprints; events: uses of templates."""

    results: DataFrame
    matches: DataFrame
    prints: DataFrame
    events: DataFrame

    @property
    def anchors(self) -> DataFrame:
        """The matches as anchors of a template."""
        return search.matches_to_anchors(self.matches)


def settled(df: DataFrame) -> DataFrame:
    """Rows that are computed once, model calls included.

    They are joined by shuffles: files hold ids and a few distinct values in so little room that Spark takes rows of all documents for small and sends them through the driver.
    """
    return scratch.written(df, "settled").hint("merge")


def decide(docs: DataFrame, pages: DataFrame, lines: DataFrame, templates: DataFrame, decision: matcher.Decision = matcher.Decision(), synonyms_match: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(one decision row per document, fingerprints).

    docs: doc_id, language, is_template; templates: template_id, t_name, t_created_at and the t_ columns of the fingerprint.
    ``synonyms_match`` compares our party with a template's (an expression over the templates' columns); without it all fit.
    """
    found = scratch.written(fingerprint.fingerprints(docs, pages, lines).withColumn("unit_pages", sim.unit(F.col("chars_per_page"))), "settled")
    pairs = matcher.shortlisted(found, templates.withColumn("synonyms_match", F.lit(True) if synonyms_match is None else synonyms_match), decision)
    return matcher.summary(matcher.decisions(found, matcher.ranked(matcher.scored(pairs), decision), decision)), found


def apply_templates(pages: DataFrame, chosen: DataFrame, anchors: DataFrame) -> DataFrame:
    """Matches of each document's chosen template: chosen (doc_id, template_id), anchors (template_id and the columns of ``search.apply_anchors``)."""
    mine = chosen.join(anchors, "template_id")
    return search.apply_anchors(pages.join(chosen.select("doc_id"), "doc_id", "left_semi"), mine)


def analyze(
    docs: DataFrame, pages: DataFrame, lines: DataFrame, templates: DataFrame, anchors: DataFrame, ask: Callable[[DataFrame], DataFrame],
    decision: matcher.Decision = matcher.Decision(), synonyms_match: Column | None = None, failed: DataFrame | None = None,
) -> Analysis:
    """Decision, places to sign and errors of every document. One without pages has the light no_match and an error: that of ``failed`` (doc_id, error), where its file could not be decoded.

    Green documents get the anchors of their template. The others, and green ones on which no anchor was found, go the way of the model:
    ``ask`` takes their ids (doc_id) and returns replies (doc_id, step, raw). A document without replies has the first step's error.
    """
    decided, prints = decide(docs, pages, lines, templates, decision, synonyms_match)
    decided = settled(decided)
    chosen = decided.where("traffic_light = 'green'").select("doc_id", "template_id")
    by_template = settled(apply_templates(pages, chosen, anchors).select(*BOXES))
    done = by_template.groupBy("doc_id").agg(F.count("*").alias("n_template"))
    rest = decided.select("doc_id").join(done, "doc_id", "left_anti").hint("merge")
    replies = rest.join(settled(ask(rest)), "doc_id", "left").select("doc_id", F.coalesce("step", F.lit("none")).alias("step"), "raw")
    sides = settled(auto.sides(replies))
    by_model = settled(auto.matches(pages, sides).select(*BOXES))
    model = auto.results(sides, by_model).select("doc_id", "error", "n_matches").join(sides.select("doc_id", "side"), "doc_id")
    rows = decided.join(done, "doc_id", "left").join(model, "doc_id", "left")
    path = F.when(F.col("n_template").isNotNull(), "template").otherwise("model")
    results = rows.select(
        "doc_id", "traffic_light", "template_id", "score", "explanation", path.alias("path"), F.when(F.col("error").isNull(), F.col("side")).alias("our_side"),
        F.coalesce("n_template", "n_matches", F.lit(0)).cast("long").alias("n_matches"), "error",
    )
    said = (docs.select("doc_id").withColumn("_said", F.lit(None).cast("string")) if failed is None else docs.select("doc_id").unionByName(failed.select("doc_id")).distinct().join(failed.select("doc_id", F.col("error").alias("_said")), "doc_id", "left"))
    lost = said.join(decided.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.coalesce(F.max("_said"), F.lit(NO_PAGES)).alias("_error"))
    missing = {"doc_id": F.col("doc_id"), "traffic_light": F.lit("no_match"), "n_matches": F.lit(0).cast("long"), "error": F.col("_error")}
    results = results.unionByName(lost.select(*[(missing.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in results.schema]))
    events = results.where("path = 'template'").select("template_id", F.lit("applied").alias("event"), F.current_timestamp().cast("string").alias("ts"))
    return Analysis(results, by_template.unionByName(by_model), prints, events)


def saved_templates(analysis: Analysis, stamp: str, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(template rows, anchor rows) of the documents with matches: fingerprint, our side's synonyms, origin and no usage.

    The id is the document's with the stamp; the name is ``name`` or follows the rule for names.
    """
    rows = analysis.prints.join(analysis.results.where("n_matches > 0").select("doc_id", "our_side"), "doc_id")
    key = F.concat(F.lit(f"tpl_{stamp}_"), F.col("doc_id").cast("string"))
    entity = F.coalesce("our_side.legal_entity", F.lit(""))
    templates = rows.select(
        key.alias("template_id"), (registry.template_name(F.col("language"), F.lit(stamp), entity) if name is None else name).alias("t_name"), F.lit(stamp).alias("t_created_at"), F.lit("pipeline_auto_1").alias("created_by"),
        *[F.col(c).alias(f"t_{c}") for c in ("language", "page_count", "total_chars", "chars_per_page", "unit_pages", "simhash", "titles")],
        entity.alias("t_entity"), F.coalesce("our_side.roles", F.array().cast("array<string>")).alias("t_roles"), F.coalesce("our_side.signer", F.lit("")).alias("t_signer"),
        *[F.lit(0).alias(c) for c in ("times_applied", "times_confirmed", "times_rejected")],
    )
    return templates, analysis.anchors.withColumn("template_id", key).drop("doc_id")


def signatures(pages: DataFrame, party: search.Party, more_patterns: tuple[str, ...] = ()) -> DataFrame:
    """Where a party signs."""
    return search.find_signatures_smart(pages, party, more_patterns)


def placements(matches: DataFrame, pages: DataFrame, options: placement.Options = placement.Options()) -> DataFrame:
    """Boxes for stamping."""
    return placement.placements(matches, pages, options)


def anchors_from_clicks(clicked: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Anchors of an operator's clicks."""
    return clicks.anchors_from_clicks(clicked, clicks.blocks(lines), pages)


class Engine:
    """One place for all of it: settings, a catalog with templates and replies, and a model. Every method is a function of this package with the engine's own things filled in."""

    def __init__(self, spark: SparkSession, config: Config | None = None, store: Catalog | None = None, model: LanguageModel | None = None):
        self.spark, self.config = spark, config or Config.from_env()
        self.store = store or self.config.catalog(spark)
        self.model = model

    def read(self, root: str, decoders: dict, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
        """(pages, failed) of the files below ``root``: pages with doc_id (a hash of the path), path, page_num, text, words and language; failed with doc_id, path and error."""
        rows = settled(files.decoded(files.documents(self.spark, root, pattern), decoders).withColumn("doc_id", F.xxhash64("path")))
        return rows.where("error is null").drop("error"), rows.where("error is not null").select("doc_id", "path", "error")

    def thresholds(self) -> matcher.Decision:
        return settings.thresholds(self.store)

    def templates(self, language: str | None = None) -> DataFrame:
        return templates.stored(self.store, language)

    def template(self, template_id: str) -> DataFrame:
        return templates.stored(self.store).where(F.col("template_id") == template_id)

    def save(self, rows: DataFrame) -> int:
        return templates.save(self.store, rows)

    def delete(self, template_id: str, stamp: str) -> bool:
        return templates.delete(self.store, template_id, stamp)

    def add_anchors(self, template_id: str, anchors: DataFrame) -> bool:
        """Adds anchors (the fields of a stored one) whose id the template lacks; whether there is such a template."""
        own = self.template(template_id)
        if own.isEmpty():
            return False
        kind = own.schema["anchors"].dataType
        new = anchors.select(F.struct(*[(F.col(f.name) if f.name in anchors.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType]).alias("a")).agg(F.collect_list("a").alias("_new")).withColumn("template_id", F.lit(template_id))
        # Each id once, in order; null ids count as one.
        ids = lambda xs: F.transform(xs, lambda a: F.coalesce(a["id"], F.lit("")))
        both = own.join(new, "template_id").withColumn("_all", F.concat(F.coalesce("anchors", F.array().cast(kind)), F.col("_new")))
        once = F.filter("_all", lambda a, i: (i < F.size("anchors")) | (F.array_position(ids(F.col("_all")), F.coalesce(a["id"], F.lit(""))) == i + 1))
        self.save(settled(both.withColumn("anchors", once).drop("_new", "_all")))
        return True

    def analyze(self, docs: DataFrame, pages: DataFrame, lines: DataFrame, prompts: Callable[[DataFrame], DataFrame], failed: DataFrame | None = None, synonyms_match: Column | None = None) -> Analysis:
        """``analyze`` against the stored templates; ``prompts`` takes ids (doc_id) and returns (doc_id, step, prompt) for the model, which is asked for each distinct one once."""
        known = self.templates()

        def ask(ids: DataFrame) -> DataFrame:
            asked = settled(prompts(ids))
            steps = [r["step"] for r in asked.select("step").distinct().orderBy("step").collect()]
            said = [self.model.complete(asked.where(F.col("step") == s), s).select("doc_id", "step", "raw") for s in steps]
            return functools.reduce(DataFrame.unionByName, said) if said else self.spark.createDataFrame([], "doc_id long, step string, raw string")

        return analyze(docs, pages, lines, templates.registry(known), templates.anchors(known), ask, self.thresholds(), synonyms_match, failed)

    def placements(self, matches: DataFrame, pages: DataFrame, options: placement.Options = placement.Options()) -> DataFrame:
        return placements(matches, pages, options)

    def anchors_from_clicks(self, clicked: DataFrame, pages: DataFrame) -> DataFrame:
        """Anchors of clicks on pages with words."""
        return clicks.anchors_from_clicks(clicked, clicks.word_blocks(pages), pages)
