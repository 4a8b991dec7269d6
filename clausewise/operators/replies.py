"""Replies of a language model: parsing, checking and merging. The model itself is a boundary.

Replies come from a table (doc_id, step, raw); ``llm.LanguageModel`` fills such a table through an injected client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import distinct_by_case, distinctive_tokens, let, strip


def unfenced(raw: Column, anywhere: bool = True) -> Column:
    """A reply without code fences: on every line, or only at its start and end."""
    flag = "(?m)" if anywhere else ""
    text = strip(F.regexp_replace(raw, flag + "^```(?:json)?", ""))
    return strip(F.regexp_replace(text, flag + "```$" if anywhere else "```\\z", ""))


def strict_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as variant; null otherwise.

    The parser stops after the first value, so the text is read as the first of two array items.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "end"]'))), "$", "array<variant>")
    return let(items, lambda xs: F.when((F.size(xs) == 2) & F.coalesce(F.try_variant_get(F.get(xs, F.lit(1)), "$", "string") == "end", F.lit(False)), F.get(xs, F.lit(0))))


def json_object(raw: Column) -> Column:
    """The JSON object in a reply, as variant; null if there is none or it does not parse."""
    text = unfenced(raw)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return strict_json(F.when(inner != "", inner).otherwise(text))


def json_array(raw: Column) -> Column:
    """The JSON array in a reply, as variant; null if there is none or it is something else."""
    text = unfenced(raw)
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    value = strict_json(F.when(inner != "", inner).otherwise(text))
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), value)


def string_items(raw: Column) -> Column:
    """The strings of a reply that is an array and nothing else; null otherwise."""
    value = strict_json(unfenced(raw, anywhere=False))
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")))


def our_side(raw: Column) -> Column:
    """Our side in a reply: struct with error null, or the error; an index and a confidence of 0.5 are needed."""

    def side(value):
        get = lambda path, kind: F.try_variant_get(value, path, kind)
        confidence = F.coalesce(get("$.confidence", "double"), F.lit(0.0))
        error = F.when(value.isNull(), "no JSON").when(get("$.our_side_index", "int").isNull() | (confidence < 0.5), "side not found")
        ok = error.isNull()
        return F.struct(
            F.when(ok, F.coalesce(get("$.our_side_synonyms.legal_entity", "string"), F.lit(""))).alias("legal_entity"),
            F.when(ok, F.coalesce(get("$.our_side_synonyms.roles", "array<string>"), F.array().cast("array<string>"))).alias("roles"),
            F.when(ok, F.coalesce(get("$.our_side_synonyms.signer", "string"), F.lit(""))).alias("signer"), F.when(ok, confidence).alias("confidence"),
            F.when(ok, get("$.all_parties", "array<struct<legal_entity: string, role: string, signer: string>>")).alias("all_parties"), error.alias("error"),
        )

    return let(json_object(raw), side)


def reply_patterns(raw: Column) -> Column:
    """Patterns of a reply, items being strings or objects; blank ones go, order and repeats stay."""
    items = F.try_variant_get(json_object(raw), "$.patterns", "array<variant>")
    text = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$.pattern", "string"), F.lit(""))).otherwise(v.cast("string"))
    return F.coalesce(F.filter(F.transform(items, lambda v: strip(text(v))), lambda t: t != ""), F.array().cast("array<string>"))


def other_aliases(side: Column) -> Column:
    """Names of the other parties of ``our_side`` that are not ours, each once."""
    low = lambda xs: F.transform(xs, F.lower)
    entity, signer = strip(side["legal_entity"]), strip(side["signer"])
    roles = F.transform(side["roles"], lambda r: F.lower(strip(r)))
    ours_e, ours_s = low(distinctive_tokens(entity)), low(distinctive_tokens(signer))

    def names(p):
        le, role, sg = (strip(F.coalesce(p[c], F.lit(""))) for c in ("legal_entity", "role", "signer"))
        own = (le != "") & (le == entity)
        first = F.when((role != "") & ~F.array_contains(roles, F.lower(role)), F.array(role)).otherwise(F.array().cast("array<string>"))
        rest = F.concat(first, F.filter(distinctive_tokens(le), lambda t: ~F.array_contains(ours_e, F.lower(t))), F.filter(distinctive_tokens(sg), lambda t: ~F.array_contains(ours_s, F.lower(t))))
        return F.when(own, F.array().cast("array<string>")).otherwise(rest)

    found = F.flatten(F.transform(F.coalesce(side["all_parties"], F.array().cast("array<struct<legal_entity: string, role: string, signer: string>>")), names))
    return distinct_by_case(F.filter(found, lambda a: F.length(strip(a)) >= 3))


def validated(matches: DataFrame, replies: DataFrame) -> DataFrame:
    """Matches with confidence, status and correction from a validator's replies (doc_id, raw).

    Of repeated verdicts on one id the last counts; without a verdict, or a reply that parses, confidence is 0.5.
    """
    each = F.posexplode(F.try_variant_get(json_array(F.col("raw")), "$", "array<variant>"))
    verdicts = replies.select("doc_id", each.alias("pos", "v")).select(
        "doc_id", "pos", F.try_variant_get("v", "$.id", "string").alias("match_id"), F.coalesce(F.try_variant_get("v", "$.confidence", "double"), F.lit(0.5)).alias("given"), F.coalesce(F.try_variant_get("v", "$.is_signature", "boolean"), F.lit(True)).alias("yes"),
    )
    last = verdicts.groupBy("doc_id", "match_id").agg(F.max(F.struct("pos", "given", "yes")).alias("w"))
    rows = matches.join(last, ["doc_id", "match_id"], "left")
    no = F.coalesce(~F.col("w.yes"), F.lit(False))
    return rows.withColumn("confidence", F.coalesce("w.given", F.lit(0.5))).withColumn("status", F.when(no, "rejected_by_llm").otherwise("candidate")).withColumn("correction_applied", F.when(no, "LLM")).drop("w")


def known_party(name: Column, parties: Column) -> Column:
    """The first party (array<struct<name, aliases>>) whose name or alias equals, holds or lies in ``name``."""
    needle = F.lower(strip(name))
    fits = lambda c: (F.lower(c) == needle) | F.contains(F.lower(c), needle) | F.contains(needle, F.lower(c))
    found = F.filter(parties, lambda p: F.exists(F.concat(F.array(p["name"]), p["aliases"]), fits))
    return F.when(name != "", F.get(found, F.lit(0))["name"])


def resolved(replies: DataFrame, parties: Column) -> DataFrame:
    """Party, confidence, evidence and error of a resolver's replies (doc_id, raw)."""
    value = strict_json(unfenced(F.col("raw"), anywhere=False))
    said = F.try_variant_get(value, "$.party", "string")
    said = F.when(~said.isin("null", ""), said)
    listed = F.exists(parties, lambda p: p["name"] == said)
    party = F.when(listed, said).otherwise(known_party(said, parties))
    error = F.when(value.isNull(), "bad reply").when(said.isNull(), "signer not found").when(party.isNull(), "unknown party")
    return replies.select(
        "doc_id", F.when(error.isNull(), party).alias("party"), F.when(error.isNull(), F.coalesce(F.try_variant_get(value, "$.confidence", "double"), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.coalesce(F.try_variant_get(value, "$.evidence", "string"), F.lit("")).alias("evidence"), error.alias("error"),
    )


def merged_patterns(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New patterns (party, language, pos, pattern) that a party's block does not have yet, each once."""
    first = Window.partitionBy("party", "language", "pattern").orderBy("pos")
    once = new.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    return once.join(existing, ["party", "language", "pattern"], "left_anti")


def parties_of_json(data: Column, language: Column) -> Column:
    """Parties of a parsed JSON map: the language's block, or all blocks together where it is missing."""
    code = F.lower(F.substring(F.coalesce(language, F.lit("")), 1, 2))

    def party(e):
        langs = e["value"]["languages"]
        own = F.map_contains_key(langs, code) & (code != "")
        pick = lambda f: F.when(own, langs[code][f]).otherwise(F.flatten(F.transform(F.map_values(langs), lambda b: F.coalesce(b[f], F.array().cast("array<string>")))))
        return F.struct(e["key"].alias("name"), F.coalesce(e["value"]["display"], e["key"]).alias("display"), F.coalesce(pick("aliases"), F.array().cast("array<string>")).alias("aliases"), F.coalesce(pick("patterns"), F.array().cast("array<string>")).alias("patterns"), F.coalesce(e["value"]["notes"], F.lit("")).alias("notes"))

    return F.transform(F.map_entries(data), party)


PARTY_HEAD = "## СТОРОНА:"


def parties_of_md(rows: DataFrame) -> DataFrame:
    """Parties of a Markdown list (doc_id, text): (doc_id, party_no, name, aliases, patterns, notes).

    A line's section, list and rule are running values over the document's lines.
    """
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head, line = F.col("line").startswith(PARTY_HEAD), F.col("line")
    mode = F.when(head | line.startswith("notes:"), "-").when(line == "aliases:", "aliases").when(line == "sign_patterns:", "patterns")
    lines = lines.withColumn("mode", F.last(mode, True).over(so_far))
    listing = F.coalesce(F.col("mode").isin("aliases", "patterns"), F.lit(False))
    # A rule ends the party, unless a list is open: there it is one more item.
    lines = lines.withColumn("party", F.last(F.when(head, F.col("pos")).when((line == "---") & ~listing, -1), True).over(so_far))
    item = strip(F.substr("line", F.lit(2)))
    item = F.when(item.rlike('(?s)^".*"$') & (F.length(item) > 1), F.substr(item, F.lit(2), F.length(item) - 2)).when(item == '"', "").otherwise(item)
    is_item = line.startswith("-") & listing
    note = strip(F.substr("line", F.lit(7)))
    note = F.regexp_replace(F.regexp_replace(note, '^"+|"+$', ""), "^'+|'+$", "")
    of = lambda m: F.transform(F.array_sort(F.collect_list(F.when(is_item & (F.col("mode") == m), F.struct("pos", item.alias("v"))))), lambda x: x["v"])
    return lines.where("party >= 0").groupBy("doc_id", F.col("party").alias("party_no")).agg(
        F.max(F.when(head, strip(F.replace(line, F.lit(PARTY_HEAD), F.lit(""))))).alias("name"), of("aliases").alias("aliases"), of("patterns").alias("patterns"),
        F.coalesce(F.max_by(F.when(line.startswith("notes:"), note), F.when(line.startswith("notes:"), F.col("pos"))), F.lit("")).alias("notes"),
    )
