"""Templates in their stored form: one JSON object a file below ``templates/`` of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from .files import Catalog

#: The fields of a stored template, of which all but the last must be there and no others may.
FIELDS = {
    "template_id": "string", "name": "string", "language": "string", "created_at": "string", "created_by": "string",
    "fingerprint": "struct<page_count: bigint, total_chars: bigint, chars_per_page: array<bigint>, header_simhash: string, section_titles: array<string>, language: string>",
    "anchors": "array<struct<id: string, anchor_type: string, anchor_level: int, anchor_text: string, position: string, offset_pt: double, generated_pattern: string, context_before: string, context_after: string, page_hint: string, added_by: string, added_at: string, bbox: array<double>>>",
    "synonyms_used": "struct<legal_entity: string, roles: array<string>, signer: string>",
    "usage_stats": "struct<times_applied: bigint, times_confirmed: bigint, times_rejected: bigint, last_used: string>",
}
PREFIX, ARCHIVE = "templates", "/_archive/"


def _files(catalog: Catalog) -> DataFrame:
    """(path, text, reason) of all template files; ``reason`` says what is wrong with one."""
    spark = catalog.spark
    if not catalog.exists(PREFIX):
        return spark.createDataFrame([], "path string, text string, reason string")
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(catalog.path(PREFIX))
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.contains("path", F.lit(ARCHIVE)))
    keys, known = F.json_object_keys("text"), F.array(*map(F.lit, FIELDS))
    needed = F.array(*[F.lit(f) for f in FIELDS if f != "usage_stats"])
    reason = F.when(F.try_parse_json("text").isNull() | keys.isNull(), "not a JSON object").when(F.size(F.array_except(needed, keys)) > 0, "fields are missing").when(F.size(F.array_except(keys, known)) > 0, "unknown fields")
    return rows.withColumn("reason", reason)


def stored(catalog: Catalog, language: str | None = None) -> DataFrame:
    """(path, the fields, recorded) of all templates that can be read, of a language (exact) or all. Bad files are left out (``skipped`` names them), archived ones too.

    ``recorded`` says whether a template holds any synonyms at all. Files are one row each, and their order is that of the paths wherever an order is asked for.
    """
    fields = F.from_json("text", ", ".join(f"{k} {v}" for k, v in FIELDS.items()))
    rows = _files(catalog).where("reason is null").select("path", fields.alias("t"), (F.size(F.json_object_keys(F.get_json_object("text", "$.synonyms_used"))) > 0).alias("recorded"))
    rows = rows.select("path", "t.*", F.coalesce("recorded", F.lit(False)).alias("recorded"))
    return rows if language is None else rows.where(F.col("language") == language)


def skipped(catalog: Catalog) -> DataFrame:
    """(path, reason) of the template files that cannot be read."""
    return _files(catalog).where("reason is not null").select("path", "reason")


def registry(templates: DataFrame) -> DataFrame:
    """``stored`` templates as the matcher takes them. Missing parts of a fingerprint are empty ones."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    fp = lambda c, other: F.coalesce(F.col(f"fingerprint.{c}"), other)
    pages = fp("chars_per_page", none("bigint"))
    record = lambda c, empty: F.when(F.col("recorded"), F.coalesce(F.col(f"synonyms_used.{c}"), empty))
    return templates.select(
        "template_id", F.col("name").alias("t_name"), F.col("created_at").alias("t_created_at"), F.coalesce("language", F.lit("")).alias("t_language"), fp("page_count", F.lit(0)).alias("t_page_count"),
        fp("total_chars", F.lit(0)).alias("t_total_chars"), pages.alias("t_chars_per_page"), sim.unit(pages).alias("t_unit_pages"), sim.parse_simhash(F.col("fingerprint.header_simhash")).alias("t_simhash"),
        fp("section_titles", none("string")).alias("t_titles"), record("legal_entity", F.lit("")).alias("t_entity"), record("roles", none("string")).alias("t_roles"), record("signer", F.lit("")).alias("t_signer"),
    )


def anchors(templates: DataFrame) -> DataFrame:
    """The anchors of ``stored`` templates as ``search.apply_anchors`` takes them, with the defaults of older templates. Those that lack what has no default are left out; a null pattern stays."""
    rows = templates.select("template_id", F.posexplode("anchors").alias("anchor_idx", "a"))
    rows = rows.where(F.expr(" and ".join(f"a.{c} is not null" for c in ("id", "anchor_level", "anchor_text", "position", "page_hint", "added_by", "bbox"))))
    box = F.struct(*[F.get("a.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    blank = lambda c, other="": F.coalesce(f"a.{c}", F.lit(other)).alias(c)
    return rows.select(
        "template_id", "anchor_idx", F.col("a.generated_pattern").alias("pattern"), "a.page_hint", blank("context_before"), "a.anchor_text", F.when(F.size("a.bbox") == 4, box).alias("bbox"),
        F.col("a.id").alias("anchor_id"), "a.position", F.coalesce("a.offset_pt", F.lit(0.0)).alias("offset_pt"), blank("context_after"), "a.added_by", blank("added_at"),
    )


def as_json(templates: DataFrame) -> DataFrame:
    """(template_id, path, text): ``stored`` templates (after changes, or new ones with the same fields) as the files that hold them."""
    rows = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    return templates.select("template_id", F.concat(F.lit(f"{PREFIX}/"), "template_id", F.lit(".json")).alias("path"), rows.alias("text"))


def save(catalog: Catalog, templates: DataFrame) -> int:
    """Writes templates to their files, one after another as they come from the executors; returns how many. A registry that changes as a whole is a table of the catalog instead."""
    n = 0
    for r in as_json(templates).toLocalIterator():
        catalog.write_text(r["path"], r["text"])
        n += 1
    return n


def delete(catalog: Catalog, template_id: str, stamp: str) -> bool:
    """Archives a template's file and deletes it; False if there is none."""
    content = catalog.read_bytes(f"{PREFIX}/{template_id}.json")
    if content is None:
        return False
    catalog.write_bytes(f"{PREFIX}{ARCHIVE}{template_id}_{stamp}.json", content)
    return catalog.delete(f"{PREFIX}/{template_id}.json")
