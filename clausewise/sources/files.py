"""File sources and sinks: documents by decoder, JSON settings, and a catalog of tables.

Decoding and language models are boundaries: a decoder or client is passed in, nothing is bundled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from posixpath import normpath
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prompts import decoder_of

WORDS = "array<struct<text: string, x0: double, y0: double, x1: double, y1: double>>"
PAGES = f"path string, page_num int, text string, error string, words {WORDS}, language string"


class Page(NamedTuple):
    """A decoded page: its text, its words (text, x0, y0, x1, y1) in reading order and, where known, the document's language."""

    text: str
    words: Sequence[tuple[str, float, float, float, float]] | None = None
    language: str | None = None


def documents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, decoder) of the files below ``root``; unsupported endings are marked, not dropped. Spark lists no files of 0 bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "content", decoder_of(F.col("path")).alias("decoder"))


def decoded(files: DataFrame, decoders: dict[str, Callable[[bytes], Iterable[str | Page]]]) -> DataFrame:
    """One row per page; a file that fails, or has no decoder, is one row with its error. Decoders yield texts or ``Page``s."""

    def job(frames):
        import pandas as pd

        box = ("text", "x0", "y0", "x1", "y1")
        for frame in frames:
            rows = []
            for path, content, kind in zip(frame["path"], frame["content"], frame["decoder"], strict=True):
                try:
                    if kind not in decoders:
                        raise ValueError(f"unsupported file: {path}")
                    found = [p if isinstance(p, Page) else Page(p) for p in decoders[kind](bytes(content))]
                    rows += [(path, i, p.text, None, None if p.words is None else [dict(zip(box, w, strict=True)) for w in p.words], p.language) for i, p in enumerate(found)]
                except Exception as e:  # the file's own row says what was wrong
                    rows.append((path, None, None, str(e), None, None))
            yield pd.DataFrame(rows, columns=["path", "page_num", "text", "error", "words", "language"]).astype({"page_num": "Int32"})

    return files.select("path", "content", "decoder").mapInPandas(job, PAGES)


class Catalog:
    """Tables and JSON objects below one root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        """The full path of an object; names that leave the root raise ValueError."""
        clean = normpath(name)
        if name.startswith("/") or clean == ".." or clean.startswith("../"):
            raise ValueError(f"outside the catalog: {name}")
        return f"{self.root}/{clean}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def delete(self, name: str) -> bool:
        """Whether something was there to delete."""
        fs, p = self._fs(self.path(name))
        return fs.delete(p, True)

    def list_prefix(self, prefix: str) -> DataFrame:
        """(path) of all files whose relative path starts with ``prefix``, in order."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        plain = "/" + self.root.split(":/", 1)[-1].lstrip("/")
        relative = F.substr(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), F.lit(len(plain) + 2))
        return found.select(relative.alias("path")).where(F.col("path").startswith(prefix)).orderBy("path")

    def read_bytes(self, name: str) -> bytes | None:
        """The whole object; null if it is not there. For settings and single files, not for tables."""
        if not self.exists(name):
            return None
        return bytes(self.spark.read.format("binaryFile").load(self.path(name)).first()["content"])

    def write_bytes(self, name: str, data: bytes) -> None:
        """Writes the object, with the folders it needs."""
        fs, p = self._fs(self.path(name))
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()

    def read_text(self, name: str) -> str | None:
        data = self.read_bytes(name)
        return None if data is None else data.decode("utf-8")

    def write_text(self, name: str, text: str) -> None:
        self.write_bytes(name, text.encode("utf-8"))

    def read_json(self, name: str):
        """The parsed object; null if it is not there. One that does not parse raises ValueError."""
        text = self.read_text(name)
        return None if text is None else json.loads(text)

    def write_json(self, name: str, value) -> None:
        self.write_text(name, json.dumps(value, ensure_ascii=False, indent=2))

    def _versions(self, name: str) -> list[int]:
        """Numbers of a table's whole versions, in order; one that was not written to its end is not among them."""
        fs, here = self._fs(self.path(name))
        if not fs.exists(here):
            return []
        found = [s.getPath() for s in fs.listStatus(here) if re.fullmatch("v=[0-9]+", s.getPath().getName())]
        done = lambda p: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(p.getName()[2:]) for p in found if done(p))

    def read_table(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table's last version, or the one asked for; null if there is none."""
        known = self._versions(name)
        if known and version in (None, *known):
            return self.spark.read.parquet(f"{self.path(name)}/v={known[-1] if version is None else version}")
        return None

    def write_table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), keep: int = 2) -> int:
        """Writes a table's next version and returns its number. Readers see it once it is whole, which a mark in its folder says, and the last ``keep`` versions stay, so plans over the one before
        still run. A write that ends early leaves the old version the last one; of two writers at once one fails."""
        known = self._versions(name)
        fs, here = self._fs(self.path(name))
        taken = [int(n[2:]) for s in (fs.listStatus(here) if fs.exists(here) else []) if re.fullmatch("v=[0-9]+", n := s.getPath().getName())]
        number = max(taken, default=0) + 1
        df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy(*partition_by).parquet(f"{self.path(name)}/v={number}")
        for old in [v for v in taken if v < number and v not in [*known, number][-keep:]]:
            self.delete(f"{name}/v={old}")
        return number


def catalog(spark: SparkSession, mode: str | None = None, root: str | None = None, env: Mapping[str, str] | None = None) -> Catalog:
    """The catalog by arguments, else by STORAGE_MODE (local or gcs), STORAGE_PATH and GCS_BUCKET, else below ./data.

    Without a mode, a named bucket means gcs. Modes of another name raise ValueError; other file systems are reached by ``Catalog`` with their URI.
    """
    env = os.environ if env is None else env
    mode = (mode or env.get("STORAGE_MODE") or ("gcs" if env.get("GCS_BUCKET") else "local")).lower()
    if mode == "local":
        return Catalog(spark, "file://" + os.path.abspath(root or env.get("STORAGE_PATH") or "data"))
    if mode == "gcs":
        bucket = root or env.get("GCS_BUCKET")
        if not bucket:
            raise ValueError("no bucket named")
        return Catalog(spark, f"gs://{bucket}")
    raise ValueError(f"unknown storage mode: {mode}")
