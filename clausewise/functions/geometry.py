"""Rectangles (struct<x0, y0, x1, y1> in points) and text search on the page layout, as column expressions.

A page's layout is searched through a function from a text to its rectangles: ``on_words`` over the boxes of a decoder's words, or
``on_lines`` over the monospaced lines of the fixtures.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.contracts import box
from .text import anchor_words, escaped, let, squeeze, strip

SAME_LINE = 4.0
SAME_ROW = 6.0
OVERLAP = 0.70
MAX_HEIGHT = 60.0


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def centre_y(r: Column) -> Column:
    return (r["y0"] + r["y1"]) / 2


def area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def merged(a: Column, b: Column) -> Column:
    """Bounding rectangle of both."""
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 where there is none."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    small = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (small > 0), w * h / small).otherwise(0.0)


def touches(a: Column, b: Column) -> Column:
    """Whether two rectangles meet, edges included."""
    return (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"]) & (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"])


RECTS = "array<struct<x0: double, y0: double, x1: double, y1: double>>"


def low(text: Column) -> Column:
    """Lower case of the same length: the one letter whose lower case is longer loses its dot."""
    return F.lower(F.translate(text, "İ", "i"))


def _occurrences(text: Column, needle: Column, each) -> Column:
    """``each(offset, size)`` of a needle's occurrences, left to right without overlaps; none of an empty needle."""
    size = F.length(needle)

    def found(parts):
        at = lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda s, p: s + F.length(p)) + (k - 1) * size
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: let(at(k), lambda c: each(c, size))))

    return F.when(size > 0, let(F.split(text, escaped(needle), -1), found))


def on_lines(page_lines: Column):
    """Search on monospaced lines: a text on one line, letter case apart."""

    def find(needle: Column) -> Column:
        on_line = lambda line, row: F.coalesce(_occurrences(low(line), low(needle), lambda c, _: box(row, c, F.length(needle))), F.array().cast(RECTS))
        return F.when(F.length(needle) > 0, F.flatten(F.transform(page_lines, on_line))).otherwise(F.array().cast(RECTS))

    return find


#: Stands between the words of an index; no word holds it.
GAP = "\x1f"


def word_index(words: Column) -> Column:
    """What ``on_words`` searches: struct<text, words>, the words of array<struct<text, x0, y0, x1, y1>> in lower case and packed into one text."""
    plain = F.transform(words, lambda w: F.translate(low(w["text"]), GAP, " "))
    boxes = F.zip_with(plain, words, lambda t, w: F.struct(F.length(t).alias("size"), *[w[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))
    return let(F.struct(plain.alias("low"), boxes.alias("boxes")), lambda b: F.struct(F.array_join(b["low"], GAP).alias("text"), b["boxes"].alias("words")))


def on_words(index: Column):
    """Search over words with boxes: a text, letter case and the kind of white space apart, one rectangle for each line that it stands on.

    The words of an occurrence are known by the gaps before it and in it; a word that it holds in part gives that share of its box. Words whose middles
    differ by at most ``SAME_LINE`` and that run on to the right are on one line.
    """

    def find(needle: Column) -> Column:
        plain = F.translate(strip(squeeze(low(needle))), " ", GAP)

        def rects(text, words, wanted):
            gaps = lambda t: F.length(t) - F.length(F.replace(t, F.lit(GAP), F.lit("")))

            def grown(state, w, size):
                share = lambda n: w["x0"] + (w["x1"] - w["x0"]) * n / w["size"]
                own = rect(share(F.greatest(F.lit(0), -state["at"])), w["y0"], share(F.least(w["size"], size - state["at"])), w["y1"])
                last = F.get(state["rects"], F.size(state["rects"]) - 1)
                same = (F.abs(centre_y(last) - centre_y(own)) <= SAME_LINE) & (own["x0"] >= last["x0"])
                more = F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(state["rects"], F.lit(1), F.size(state["rects"]) - 1), F.array(merged(last, own)))).otherwise(F.concat(state["rects"], F.array(own)))
                return F.struct((state["at"] + w["size"] + 1).alias("at"), more.alias("rects"))

            def each(at, size):
                before = F.left(text, at)
                inside = F.length(F.substring_index(before, GAP, -1))
                return F.aggregate(
                    F.slice(words, gaps(before) + 1, gaps(wanted) + 1), F.struct((-inside).alias("at"), F.array().cast(RECTS).alias("rects")), lambda state, w: grown(state, w, size), lambda state: state["rects"]
                )

            return F.flatten(F.coalesce(_occurrences(text, wanted, each), F.array().cast(f"array<{RECTS}>")))

        return let(F.struct(plain.alias("n"), index["text"].alias("t"), index["words"].alias("w")), lambda b: rects(b["t"], b["w"], b["n"]))

    return find


def line_rects(find) -> Column:
    """Rectangles of the lines to sign on."""
    return F.concat(find(F.lit("___")), find(F.lit(".....")))


def text_rects(find, matched: Column) -> Column:
    """Where a matched text stands on its page.

    The exact text; else, by what it is made of: its underline, its first word, or each of its words
    joined with the nearest underline on the same line.
    """
    under = matched.contains("__")

    def nearest(a, lines):
        gap = lambda u: F.when(u["x0"] >= a["x1"], u["x0"] - a["x1"]).when(u["x1"] <= a["x0"], a["x0"] - u["x1"]).otherwise(0.0)
        same = F.filter(lines, lambda u: F.abs(centre_y(u) - centre_y(a)) <= SAME_LINE)
        return F.array_min(F.transform(same, lambda u, i: F.struct(gap(u).alias("gap"), i.alias("i"), u.alias("u"))))

    def fallback(b):
        words, lines = b["words"], b["lines"]
        first = F.slice(find(F.coalesce(F.get(words, F.lit(0)), F.lit(""))), 1, 1)

        def with_words(found):
            pairs = F.transform(found, lambda a: F.struct(a.alias("a"), nearest(a, lines).alias("n")))
            joined = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["n"].isNotNull()), lambda p: merged(p["a"], p["n"]["u"])))
            best = let(joined, lambda js: F.when(F.size(js) > 0, js).otherwise(first))
            return F.when(F.size(found) == 0, F.slice(lines, 1, 1)).when(F.size(lines) == 0, F.slice(found, 1, 1)).otherwise(best)

        both = let(F.flatten(F.transform(words, lambda w: find(w))), with_words)
        return F.when(under, F.when(F.size(words) == 0, F.slice(lines, 1, 1)).otherwise(both)).when(F.size(words) > 0, first).otherwise(F.array().cast(RECTS))

    parts = F.struct(anchor_words(matched).alias("words"), find(F.lit("___")).alias("lines"))
    return let(find(matched), lambda exact: F.when(F.size(exact) > 0, exact).otherwise(let(parts, fallback)))


def marker_rects(find, marker: Column) -> Column:
    """Where a reply's marker text stands: exact, else its first longer word that is found, else the first underline."""
    exact = find(marker)
    words = anchor_words(marker)
    found = F.filter(F.transform(words, lambda w: find(w)), lambda r: F.size(r) > 0)
    lines = F.when(marker.contains("__"), F.slice(find(F.lit("___")), 1, 1)).otherwise(F.slice(exact, 1, 0))
    return F.when(F.size(exact) > 0, exact).when(F.size(found) > 0, F.slice(F.get(found, F.lit(0)), 1, 1)).otherwise(lines)


def without_overlaps(rows: Column) -> Column:
    """Of an array of structs with field ``r``, in order, those that do not cover an earlier kept one."""
    none = F.filter(rows, lambda _: F.lit(False))
    return F.aggregate(rows, none, lambda kept, c: F.when(F.exists(kept, lambda k: overlap_ratio(c["r"], k["r"]) > OVERLAP), kept).otherwise(F.concat(kept, F.array(c))))


def one_per_row(rows: Column) -> Column:
    """Smallest first, those that share no line of text and columns with a kept one; ``seq`` orders equal areas."""
    none = F.filter(rows, lambda _: F.lit(False))
    ordered = F.transform(F.array_sort(F.transform(rows, lambda c: F.struct(area(c["r"]).alias("area"), c["seq"].alias("seq"), c.alias("c")))), lambda s: s["c"])
    clash = lambda c, k: (F.abs(centre_y(c["r"]) - centre_y(k["r"])) <= SAME_ROW) & (F.least(c["r"]["x1"], k["r"]["x1"]) > F.greatest(c["r"]["x0"], k["r"]["x0"]))
    return F.aggregate(ordered, none, lambda kept, c: F.when(F.exists(kept, lambda k: clash(c, k)), kept).otherwise(F.concat(kept, F.array(c))))


def position(r: Column, x: Column, y: Column) -> Column:
    """Where a click lies as seen from a block: struct<position, offset>, the offset from its centre."""
    dx, dy = x - (r["x0"] + r["x1"]) / 2, y - centre_y(r)
    level = F.abs(dy) <= 15
    name = F.when(level & (dx > 5), "right").when(level & (dx < -5), "left").when(level, "on").when(dy > 0, "below").otherwise("above")
    offset = F.when(level & (F.abs(dx) > 5), F.abs(dx)).when(level, 0.0).otherwise(F.abs(dy))
    return F.struct(name.alias("position"), offset.alias("offset"))


def signature_box(r: Column, where: Column, offset: Column) -> Column:
    """Room for a signature beside a block."""
    w = F.least(F.lit(150.0), F.greatest(F.lit(80.0), (r["x1"] - r["x0"]) * 1.2))
    h = F.least(F.lit(15.0), F.greatest(F.lit(8.0), r["y1"] - r["y0"]))
    return (
        F.when(where == "right", rect(r["x1"] + offset, r["y0"], r["x1"] + offset + w, r["y0"] + h))
        .when(where == "left", rect(r["x0"] - offset - w, r["y0"], r["x0"] - offset, r["y0"] + h))
        .when(where == "below", rect(r["x0"], r["y1"] + offset, r["x0"] + w, r["y1"] + offset + h))
        .when(where == "above", rect(r["x0"], r["y0"] - offset - h, r["x0"] + w, r["y0"] - offset))
        .otherwise(rect(r["x0"], r["y0"], r["x0"] + w, r["y0"] + h))
    )
