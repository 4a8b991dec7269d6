"""Words and their lines are made in linear time: a line of very many words is one among others."""

import time

from pyspark.sql import functions as F

from clausewise.operators import clicks
from clausewise.sources import contracts


def test_a_line_of_very_many_words(spark):
    text = "\n".join(["First line", " ".join(f"w{i % 97}" for i in range(40_000)), "", "  Last  _____"])
    docs = spark.createDataFrame([(1, "en", False, text)], "doc_id long, language string, is_template boolean, text string")
    begin = time.perf_counter()
    pages = contracts.word_pages(docs).select("page_num", F.size("words").alias("n"), F.get("words", F.lit(0)).alias("first"), F.get(F.reverse("words"), F.lit(0)).alias("last")).orderBy("page_num").collect()
    assert time.perf_counter() - begin < 20
    assert [p.n for p in pages] == [40_002, 2]
    wide = lambda w: float(sum(3 + ord(c) % 5 for c in w))
    assert tuple(pages[0].first) == ("First", 50.0, 50.0, 50.0 + wide("First"), 62.0)
    at = 50.0 + sum(wide(f"w{i % 97}") + 5.0 for i in range(39_999))
    assert tuple(pages[0].last) == (f"w{39_999 % 97}", at, 70.0, at + wide(f"w{39_999 % 97}"), 82.0)
    assert [pages[1].first.x0, pages[1].last.x0] == [60.0, 60.0 + wide("Last") + 10.0]


def test_lines_of_words_with_missing_boxes(spark):
    words = [("a", 0.0, 0.0, 5.0, 10.0), ("b", 6.0, 3.0, 9.0, 13.0), ("c", 2.0, 3.0, 4.0, 13.0), (None, 5.0, 3.0, 6.0, 13.0), ("d", None, 3.0, 8.0, 13.0)]
    rows = spark.createDataFrame([(1, 0, words), (1, 1, []), (1, 2, None), (2, 0, words[2:3])], "doc_id long, page_num int, words array<struct<text: string, x0: double, y0: double, x1: double, y1: double>>")
    got = [(r.doc_id, r.page_num, r.block_no, r.text, *r.r) for r in clicks.word_blocks(rows).orderBy("doc_id", "page_num", "block_no").collect()]
    assert got == [(1, 0, 0, "a b", 0.0, 0.0, 9.0, 13.0), (1, 0, 1, "c", 2.0, 3.0, 6.0, 13.0), (1, 0, 2, "d", None, 3.0, 8.0, 13.0), (2, 0, 0, "c", 2.0, 3.0, 4.0, 13.0)]
