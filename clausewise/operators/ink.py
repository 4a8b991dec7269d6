"""Measures of ink on scanned signatures. Decoding and thresholding are a boundary: a mask of one byte a pixel comes in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import ink_confidence

#: Pixels added around the ink, and what is said without any.
MARGIN, NO_INK = 12, "no ink"
MEASURES = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "w", "h")] + [T.StructField(c, T.DoubleType()) for c in ("share", "coverage")])


@F.pandas_udf(MEASURES)
def measures(ink: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Box of the ink with its margin, the ink's share of the image and of the box; the whole image and zeros without ink."""
    rows = []
    for mask, w, h in zip(ink, width, height, strict=True):
        pixels = np.frombuffer(bytes(mask or b"").ljust(w * h, b"\0")[: w * h], np.uint8).reshape(h, w) != 0
        columns, lines = np.flatnonzero(pixels.any(axis=0)), np.flatnonzero(pixels.any(axis=1))
        if not columns.size:
            rows.append((0, 0, w, h, 0.0, 0.0))
            continue
        x, y = max(0, columns[0] - MARGIN), max(0, lines[0] - MARGIN)
        bw = min(w - x, columns[-1] - columns[0] + 1 + 2 * MARGIN)
        bh = min(h - y, lines[-1] - lines[0] + 1 + 2 * MARGIN)
        n = int(pixels.sum())
        rows.append((x, y, bw, bh, n / (w * h), int(pixels[y : y + bh, x : x + bw].sum()) / (bw * bh)))
    return pd.DataFrame(rows, columns=MEASURES.names)


def measured(images: DataFrame, ink: Column | None = None) -> DataFrame:
    """Adds box, coverage, confidence and warnings to images (width, height, ink: one byte a pixel, row by row, not 0 for ink)."""
    rows = images.withColumn("_m", measures(F.col("ink") if ink is None else ink, "width", "height"))
    said = ink_confidence(F.col("_m.share"), F.col("_m.w").cast("double"), F.col("_m.h").cast("double"), F.col("width"), F.col("height"))
    none = F.col("_m.share") == 0
    rows = rows.withColumn("_c", said)
    box = F.struct(*[F.col(f"_m.{c}").alias(c) for c in ("x", "y", "w", "h")])
    return rows.select(
        *images.columns, box.alias("bbox"), F.col("_m.coverage").alias("coverage"), F.when(none, 0.0).otherwise(F.col("_c.confidence")).alias("confidence"),
        F.when(none, F.array(F.lit(NO_INK))).otherwise(F.col("_c.warnings")).alias("warnings"),
    )
