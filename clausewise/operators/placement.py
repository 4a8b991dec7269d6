"""Where signatures and markers go on a page; stamping itself is a boundary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .search import finder, layout, with_layout

HEIGHT, LEAST, MOST, SHIFT = 42.0, 20.0, 85.0, 20.0


@dataclass(frozen=True)
class Options:
    scale: float = 1.0
    aspect: float = 2.0
    marker_color: str = "pink"
    page_width: float = 595.0


def placements(matches: DataFrame, pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Signature and marker boxes of the matches that are neither excluded nor rejected.

    matches: doc_id, match_id, page_num, x0..y1, pattern, status, operator_excluded. The signature stands on the
    underline next to the match, if its page has one, else on the lower edge of the match.
    """
    kept = matches.where("not operator_excluded and status <> 'rejected_by_llm'")
    pages = with_layout(pages)
    rows = kept.join(pages.select("doc_id", "page_num", layout(pages)), ["doc_id", "page_num"])
    r = geo.rect(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    lines = F.transform(finder(rows)(F.lit("___")), lambda u, i: F.struct(F.abs(geo.centre_y(u) - geo.centre_y(r)).alias("d"), i.alias("i"), u.alias("u")))
    near = F.filter(lines, lambda c: (c["u"]["y1"] >= F.col("y0") - 2) & (c["u"]["y0"] <= F.col("y1") + 2) & (c["u"]["x0"] >= F.col("x0") - 10) & (c["u"]["x0"] <= F.col("x1")))
    rows = rows.withColumn("u", F.array_min(near)["u"])
    on_line = F.col("pattern").startswith("_")
    x = F.when(on_line, F.col("x0") + SHIFT).when(F.col("u").isNotNull(), F.col("u.x0") + SHIFT).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * 0.3)
    y = F.when(~on_line & F.col("u").isNotNull(), F.col("u.y1")).otherwise(F.col("y1"))
    h = min(max(LEAST, HEIGHT * options.scale), MOST)
    middle = (F.col("y0") + F.col("y1")) / 2
    return rows.select(
        "doc_id", "match_id", "page_num", x.alias("sig_x0"), (y - h).alias("sig_y0"), (x + h * options.aspect).alias("sig_x1"), y.alias("sig_y1"),
        F.lit(options.page_width - 14.0).alias("mark_x0"), (middle - 17.0).alias("mark_y0"), F.lit(options.page_width - 3.0).alias("mark_x1"), (middle + 17.0).alias("mark_y1"),
        F.lit("gray" if options.marker_color == "gray" else "pink").alias("mark_color"),
    )


def highlights(matches: DataFrame, scale: float = 1.5) -> DataFrame:
    """Boxes to draw on a page preview; excluded matches are gray."""
    return matches.select("doc_id", "match_id", "page_num", *[(F.col(c) * scale).alias(c) for c in ("x0", "y0", "x1", "y1")], F.when(F.col("operator_excluded"), "gray").otherwise("red").alias("color"))
