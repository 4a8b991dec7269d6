"""The language-model boundary: prompts out, replies in, through an injected client, each distinct prompt asked once."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.replies import json_object
from . import scratch
from .files import Catalog

#: Fixed value: what a prompt asks for when the reply must be an object.
ONLY_JSON = "Respond ONLY with valid JSON matching this schema. No markdown, no explanation.\nSchema: "
WRONG = "not the JSON that was asked for"
REPLIES = "key string, raw string, error string"


class LanguageModel:
    """Fills a reply table (doc_id, step, raw). ``client`` takes (prompt, max_tokens) and returns text; it runs on the executors, ``calls`` at once in a task.

    Replies are known by a hash of model, limit and prompt. With a ``store`` they are kept below its ``replies`` folder, and later runs ask only for prompts without one; without it they are kept for one run. Either way
    they are written before they are used, so a task that is lost later asks nothing again; one that is lost while it asks repeats its own prompts only (``rounds`` parts are written one after another).
    A call that fails is an empty reply, is not kept, and its error stands beside it.
    """

    def __init__(self, client: Callable[[str, int], str], model: str = "", store: Catalog | None = None, calls: int = 4, rounds: int = 1):
        self.client, self.model, self.store, self.calls, self.rounds = client, model, store, calls, rounds

    def is_available(self) -> bool:
        """Whether there is a client, and it does not say otherwise."""
        own = getattr(self.client, "is_available", None)
        return self.client is not None and (own is None or bool(own()))

    def _known(self, spark) -> DataFrame:
        if self.store is not None and self.store.exists("replies"):
            return spark.read.schema("key string, raw string").parquet(self.store.path("replies"))
        return spark.createDataFrame([], "key string, raw string")

    def _asked(self, prompts: DataFrame, max_tokens: int) -> DataFrame:
        client, calls = self.client, self.calls

        def one(prompt):
            try:
                return client(prompt, max_tokens), None
            except Exception as e:  # the document gets the step's error
                return None, str(e) or type(e).__name__

        def job(frames):
            import pandas as pd

            with ThreadPoolExecutor(calls) as pool:
                for frame in frames:
                    said = list(pool.map(one, frame["prompt"]))
                    yield pd.DataFrame({"key": frame["key"], "raw": [r for r, _ in said], "error": [e for _, e in said]})

        return prompts.mapInPandas(job, REPLIES)

    def _replies(self, prompts: DataFrame, max_tokens: int) -> DataFrame:
        """(key, raw, error) of distinct prompts (key, prompt): kept ones, and new ones once they are written."""
        known = self._known(prompts.sparkSession)
        missing = scratch.written(prompts.join(known, "key", "left_anti"), "prompts")
        parts = []
        for r in range(self.rounds):
            part = scratch.written(self._asked(missing.where(F.pmod(F.xxhash64("key"), F.lit(self.rounds)) == r), max_tokens), "replies")
            if self.store is not None:
                part.where("error is null").select("key", "raw").write.mode("append").parquet(self.store.path("replies"))
            parts.append(part)
        out = prompts.select("key").join(known.dropDuplicates(["key"]), "key").withColumn("error", F.lit(None).cast("string"))
        for part in parts:
            out = out.unionByName(part)
        return out

    def complete(self, prompts: DataFrame, step: str, max_tokens: int = 1000) -> DataFrame:
        """(doc_id, step, raw, error) of prompts (doc_id, prompt). Null prompts have null replies."""
        return self._completed(prompts, step, max_tokens, F.lit(True), 0)

    def complete_structured(self, prompts: DataFrame, schema: dict, step: str, max_tokens: int = 1024, retries: int = 1) -> DataFrame:
        """``complete`` of (doc_id, system, user) for one JSON object. A reply that is none, or lacks a field that the schema requires, is asked for again, up to ``retries`` times; then it is null with an error."""
        asked = F.concat_ws("\n\n", "system", F.lit(ONLY_JSON + json.dumps(schema)), "user")
        whole = json_object(F.col("raw"))
        there = [F.try_variant_get(whole, f"$['{name}']", "variant").isNotNull() for name in schema.get("required", [])]
        return self._completed(prompts.select("doc_id", asked.alias("prompt")), step, max_tokens, functools.reduce(Column.__and__, there, whole.isNotNull()), retries)

    def _completed(self, prompts: DataFrame, step: str, max_tokens: int, good: Column, retries: int) -> DataFrame:
        # A repeated call is another prompt to the store: its number is part of the key.
        key = lambda call: F.sha2(F.concat_ws("\x00", F.lit(self.model), F.lit(str(max_tokens)), F.lit(str(call)), F.col("prompt")), 256)
        rest, parts = scratch.written(prompts.where("prompt is not null").select("prompt").distinct(), "asked"), []
        for call in range(retries + 1):
            keyed = rest.withColumn("key", key(call))
            said = keyed.join(self._replies(keyed.select("key", "prompt"), max_tokens), "key")
            said = scratch.written(said.select("prompt", "raw", F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(good, F.lit(False)), WRONG).alias("error")), "said")
            parts.append(said.where("error is null") if call < retries else said)
            rest = said.where("error is not null").select("prompt")
        out = functools.reduce(DataFrame.unionByName, parts).withColumn("raw", F.when(F.col("error").isNull(), F.col("raw")))
        return prompts.select("doc_id", "prompt").join(out, "prompt", "left").select("doc_id", F.lit(step).alias("step"), "raw", "error")
