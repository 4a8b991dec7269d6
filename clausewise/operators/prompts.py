"""Prompts and small configuration rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a party is listed for the model.
ALIASES_SHOWN, DISPLAY_SHOWN = " (синонимы/языковые варианты: ", "; отображение: "
#: What stands for missing names, and languages as a prompt names them.
NOT_GIVEN, NOT_KNOWN, NO_COMPANY, COMPANY = "(не указано)", "(не определено)", "Компания: (не указана)", 'Компания: "'
SPOKEN = {"ru": "русском", "en": "английском", "pl": "польском"}
#: How many locations are shown to the model.
SHOWN = 5


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places, filled one after the other: a value that holds a later place is filled again."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def filled_once(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places, all filled at once: places inside a value, and names without one, stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values.get(p, F.lit("{" + p + "}")) for i, p in enumerate(parts)])


def _named(column: Column, missing: str) -> Column:
    return F.when(F.coalesce(column, F.lit("")) == "", missing).otherwise(column)


def _listed(column: Column, missing: str) -> Column:
    return F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.array_join(column, ", ")).otherwise(missing)


def indented_json(items: Column, fields: tuple[str, ...]) -> Column:
    """An array of structs as JSON with two spaces a level; nulls are written."""
    value = lambda x, f: F.regexp_extract(F.to_json(F.struct(x[f].alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    line = lambda x, f: F.concat(F.lit(f'    "{f}": '), value(x, f))
    item = lambda x: F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[line(x, f) for f in fields]), F.lit("\n  }"))
    return F.when(F.size(items) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(items, item), ",\n"), F.lit("\n]"))).otherwise("[]")


# Values of the seven prompts. The wording is the caller's template; the prompt of ``pattern_values`` is filled by ``filled``, the others by ``filled_once``.


def side_values(header: Column, language: Column, company: Column, signer: Column, markers: Column) -> dict[str, Column]:
    """Which side is ours: aliases are arrays, markers JSON."""
    return {"header_text": header, "language": language, "company_aliases": _listed(company, NOT_GIVEN), "signer_aliases": _listed(signer, NOT_GIVEN), "markers": markers}


def pattern_values(entity: Column, roles: Column, signer: Column, language: Column, underlines: Column, words: Column, fragments: Column) -> dict[str, Column]:
    """Patterns for a side, in the order in which places are filled."""
    return {
        "legal_entity": _named(entity, NOT_KNOWN), "roles": _listed(roles, NOT_KNOWN), "signer": _named(signer, NOT_KNOWN), "language": language,
        "underline_patterns": F.array_join(underlines, ", "), "marker_words": F.array_join(words, ", "), "strategic_fragments": fragments,
    }


def extraction_values(text: Column, party: Column, language: Column, task_rules: Column, quality_rules: Column, refinement: Column, previous: Column, again: str, more: str) -> dict[str, Column]:
    """Patterns from a document's text.

    A refinement is shown in the template ``again`` where there is a previous result (struct<patterns, found_locations> as JSON texts), else in ``more``; without one nothing is.
    """
    told = filled_once(again, {"patterns": previous["patterns"], "found_locations": previous["found_locations"], "refinement": refinement})
    block = F.when(F.coalesce(refinement, F.lit("")) == "", "").when(previous.isNotNull(), told).otherwise(filled_once(more, {"refinement": refinement}))
    spoken = F.coalesce(*[F.when(language == k, v) for k, v in SPOKEN.items()], language)
    return {"doc_text": text, "party_name": party, "language": spoken, "sign_task_rules": task_rules, "pattern_quality_rules": quality_rules, "refinement": block}


def regeneration_values(party: Column, locations: Column, fields: tuple[str, ...], raw_text: Column, rules: Column) -> dict[str, Column]:
    """Patterns made again from raw text."""
    return {"party_name": party, "locations": indented_json(F.slice(locations, 1, SHOWN), fields), "raw_text": raw_text, "from_lines_rules": rules}


def narrowing_values(party: Column, locations: Column, fields: tuple[str, ...], raw_text: Column, actual: Column, counts: Column, strategies: Column) -> dict[str, Column]:
    """Greedy patterns narrowed: ``counts`` are the lines of matches by pattern."""
    expected = F.size(locations)
    numbers = {"expected": expected, "actual": actual, "surplus": actual - expected}
    return regeneration_values(party, locations, fields, raw_text, F.lit("")) | {k: v.cast("string") for k, v in numbers.items()} | {"counts": counts, "narrow_strategies": strategies}


def validation_values(items: Column, party: Column, rules: Column) -> dict[str, Column]:
    """Found places checked: items are array<struct<id, page, context, pattern>>."""
    return {"items": indented_json(items, ("id", "page", "context", "pattern")), "party_name": party, "validator_rules": rules}


def resolver_values(text: Column, signer: Column, company: Column, parties: Column, rules: Column) -> dict[str, Column]:
    """The party of a signer, among the lines of ``party_lines``."""
    line = F.when(F.coalesce(company, F.lit("")) == "", NO_COMPANY).otherwise(F.concat(F.lit(COMPANY), company, F.lit('"')))
    return {"doc_text": text, "signer_name": signer, "company": line, "parties": parties, "resolver_rules": rules}


def party_lines(parties: Column) -> Column:
    """Parties (array<struct<name, display, aliases>>) as a list for a prompt."""

    def line(p):
        shown = F.coalesce(F.when(p["display"] != "", p["display"]), p["name"])
        head = F.concat(F.lit('- "'), p["name"], F.lit('"'))
        return F.when(F.size(p["aliases"]) > 0, F.concat(head, F.lit(ALIASES_SHOWN), F.array_join(p["aliases"], ", "), F.lit(DISPLAY_SHOWN), shown, F.lit(")"))).otherwise(F.concat(head, F.lit(" ("), shown, F.lit(")")))

    return F.array_join(F.transform(parties, line), "\n")


def decoder_of(path: Column) -> Column:
    """Which decoder reads a file, by its name's ending."""
    ending = F.regexp_extract(F.lower(path), r"\.([^./]*)$", 1)
    return F.when(ending.isin("pdf", "docx"), ending).otherwise("unsupported")


def language_code(language: Column, detected: Column) -> Column:
    """A supported two-letter code: the given one, else the detected one, else ru."""
    code = lambda c: F.when(F.lower(F.substring(c, 1, 2)).isin("ru", "en", "pl"), F.lower(F.substring(c, 1, 2)))
    return F.coalesce(code(language), code(detected), F.lit("ru"))


def first_setting(*places: Column) -> Column:
    """The first stored value; the last place is the default."""
    return F.coalesce(*places)


def merged_settings(defaults: Column, stored: Column) -> Column:
    """Default settings with the stored keys over them."""
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(F.coalesce(stored, F.create_map().cast("map<string,string>")), k))
    return F.when(stored.isNull(), defaults).otherwise(F.map_concat(kept, stored))
