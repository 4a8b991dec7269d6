"""Text rules as column expressions. They stay inside generated code: no Python on rows.

Python-style ``\\s`` and ``\\w`` are spelled out as Unicode classes, since the regular-expression
engines of Spark and DuckDB read the short forms as ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"

#: Words of an alias that never identify a party.
ALIAS_STOP_WORDS = (
    "общество", "ограниченной", "ответственностью", "компания", "корпорация",
    "генеральный", "директор", "лице", "именуем", "именуемая", "именуемое",
    "именуемый", "далее", "стороны", "стороне", "договор", "договору",
    "ооо", "оао", "зао", "ао", "ип", "пао", "не", "указано", "указана",
    "физическое", "юридическое", "лицо",
)
#: Capitalised words that are not distinctive in a party's name.
NAME_STOP_WORDS = (
    "общество", "ограниченной", "ответственностью", "компания",
    "корпорация", "генеральный", "директор", "лице", "именуем",
    "именуемая", "именуемое", "именуемый", "далее", "стороны",
    "стороне", "договор", "договору",
)
#: A name that means "none given".
BLANK_NAMES = ("не указан", "не указана", "не указано", "—", "-", "n/a", "na", "")
#: Role words that show that an alias names a post, not a signer.
ROLE_WORDS = (
    "руководитель", "руководителя", "руководителю", "руководителем",
    "начальник", "начальника", "начальнику", "начальником",
    "сотрудник", "сотрудника", "сотруднику", "сотрудником",
    "специалист", "специалиста", "специалисту", "специалистом",
    "менеджер", "менеджера", "менеджеру", "менеджером",
    "координатор", "координатора", "координатору",
    "работник", "работника", "работнику", "работником",
    "помощник", "помощника", "помощнику",
    "глава", "главы", "главу", "главой",
    "зам", "заместитель", "заместителя", "заместителю",
    "ответственный", "ответственного", "ответственному",
    "должность", "должности", "должностью",
    "представители", "представителя", "представителю", "представителем",
    "служба", "службы", "службу", "службе", "службой",
)


def quoted(text: str) -> str:
    """A SQL string literal that keeps backslashes, whatever the parser's settings."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim of all Unicode white space."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text, f"{WS}+", " ")


def find_all(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(group))


def distinct_by_case(words: Column) -> Column:
    """First of each word in order, letter case apart; the first spelling stays."""

    def firsts(w):
        low = F.transform(w["w"], F.lower)
        return let(low, lambda lo: F.filter(w["w"], lambda x, i: F.array_position(lo, F.lower(x)) == i + 1))

    return let(F.struct(words.alias("w")), firsts)


def anchor_words(text: Column) -> Column:
    """Words of three letters and more around a signature line, each once."""
    plain = F.regexp_replace(text, "_{2,}", " ")
    return distinct_by_case(F.filter(find_all(plain, WORD), lambda w: F.length(w) >= 3))


def alias_tokens(alias: Column) -> Column:
    """Words of an alias that can identify its party."""
    plain = F.translate(F.coalesce(alias, F.lit("")), "«»\"'()/\\", "        ")
    stop = F.array(*map(F.lit, ALIAS_STOP_WORDS))
    return distinct_by_case(F.filter(find_all(plain, WORD), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, F.lower(w))))


def distinctive_tokens(name: Column) -> Column:
    """Quoted phrases, their longer words, and capitalised words of a name."""
    text = F.coalesce(name, F.lit(""))
    inner = F.filter(F.transform(find_all(text, "[«\"']([^»\"']+)[»\"']", 1), strip), lambda q: F.length(q) >= 3)
    phrases = F.flatten(F.transform(inner, lambda q: F.concat(F.array(q), F.filter(F.split(q, f"{WS}+"), lambda w: F.length(w) >= 4))))
    stop = F.array(*map(F.lit, NAME_STOP_WORDS))
    capital = F.filter(find_all(text, "[А-ЯA-ZЁ][а-яa-zА-ЯA-ZёЁ\\-]{3,}"), lambda w: ~F.array_contains(stop, F.lower(w)))
    blank = F.lower(strip(text)).isin(*BLANK_NAMES)
    return F.when(blank, F.array().cast("array<string>")).otherwise(distinct_by_case(F.concat(phrases, capital)))


def spans(text: Column, pattern: str | Column) -> Column:
    """All matches in order as array<struct<start, stop, matched>>; the pattern must not match the empty string.

    The pieces between matches and the matches alternate, so running lengths give the offsets. A text without a match is not cut.
    """

    def of(b):
        sizes = F.zip_with(F.transform(b["gaps"], F.length), F.transform(b["found"], F.length), lambda g, m: F.struct(F.coalesce(g, F.lit(0)).alias("g"), F.coalesce(m, F.lit(0)).alias("m")))
        start = F.aggregate(
            sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda a, s: F.struct((a["at"] + s["g"] + s["m"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + s["g"])).alias("starts")),
            lambda a: a["starts"],
        )
        return let(start, lambda at: F.transform(b["found"], lambda m, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("stop"), m.alias("matched"))))

    none = F.array().cast("array<struct<start: int, stop: int, matched: string>>")
    pieces = lambda found: F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(find_all(text, pattern), lambda found: F.when(F.size(found) == 0, none).otherwise(let(pieces(found), of)))


def signature_line(text: Column) -> Column:
    """Whether a text holds a line to sign on."""
    return text.rlike(r"_{3,}|\.{5,}")


def snippet(text: Column, start: Column, stop: Column, around: int = 40) -> Column:
    """The text around a match, on one line."""
    frm = F.greatest(F.lit(0), start - around)
    return strip(F.translate(F.substr(text, frm + 1, stop + around - frm), "\n", " "))


def in_role_phrase(before: Column, matched: Column, tokens: Column) -> Column:
    """Whether one of the last three words before an alias token names a post.

    For every occurrence of a token, the 30 characters before it are read.
    """
    roles = F.array(*map(F.lit, ROLE_WORDS))

    def named(preceding):
        return let(find_all(preceding, "[а-яёa-z]+"), lambda words: F.arrays_overlap(roles, F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), F.lit(3))))

    def hit(whole, token):
        def each(parts):
            size = lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda s, p: s + F.length(p)) + (k - 1) * F.length(token)
            return F.when(F.size(parts) > 1, F.exists(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: named(F.right(F.left(whole, size(k)), F.lit(30))))).otherwise(False)

        return let(F.split(whole, escaped(F.lower(token)), -1), each)

    return let(F.lower(F.concat(before, F.lit(" "), matched)), lambda whole: F.exists(tokens, lambda t: hit(whole, t)))


def escaped(text: Column) -> Column:
    """A text with pattern metacharacters escaped."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}_])", r"\\$1")
