"""Documents and events as they arrive: batch operators on every micro-batch, counters of templates that are brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry
from ..sources.files import Catalog


def each_batch(arriving: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on every micro-batch and append its rows below ``out``, one folder a batch.

    The folder is named by the batch, so a batch that is run again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_counters(events: DataFrame, store: Catalog, name: str, checkpoint: str) -> StreamingQuery:
    """Counters of templates from a stream of events (template_id, event, ts): a table of the catalog that each micro-batch brings up to date, whatever is run again.

    Every version of the table holds the number of its last batch in a row of its own, and becomes visible as a whole. A batch whose number it already holds is skipped, so each event counts once. A batch adds
    its own partial counts to the table; no event is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        merge_usage(store, name, batch, number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_usage(store: Catalog, name: str, events: DataFrame, number: int) -> bool:
    """Adds one batch to the counters, unless they hold it; whether they did not."""
    old = store.read_table(name)
    if old is not None and old.agg(F.max("batch")).first()[0] >= number:
        return False
    mine = registry.counted(events).withColumn("batch", F.lit(None).cast("long"))
    mark = events.sparkSession.createDataFrame([(None, 0, 0, 0, None, number)], mine.schema)
    if old is not None:
        both = old.where("template_id is not null").unionByName(mine)
        mine = both.groupBy("template_id").agg(*[F.sum(c).alias(c) for c in ("times_applied", "times_confirmed", "times_rejected")], F.max("last_used").alias("last_used")).withColumn("batch", F.lit(None).cast("long"))
    store.write_table(mine.unionByName(mark), name)
    return True


def usage_of(store: Catalog, name: str, templates: DataFrame) -> DataFrame:
    """The counters of all templates, 0 where there were no events."""
    known = store.read_table(name)
    counts = registry.counted(templates.sparkSession.createDataFrame([], "template_id string, event string, ts string")) if known is None else known.where("template_id is not null").drop("batch")
    return registry.with_counts(templates, counts)
