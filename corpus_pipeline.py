"""The training-corpus pipeline: stages over ``documents``, each one operator of clausewise.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import mixing, toxicity
from clausewise.llm.jaccard_join import SENT, ngram_jaccard_join
from clausewise.llm.sentencepiece import encode_documents
from clausewise.llm.store import cut, table
from clausewise.llm.substring_dedup import substring_dedup


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with private names for all columns but ``own``, so that none is taken for a column that an operator adds; and the names in order."""
    names = [c if c in own else f"_user{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go. Labels whose crc32(doc_id) mod 5 is 0 are held out of the fit.

    Null and empty texts hold no evidence and get the score of that. Without labels everything stays; where all labels are toxic everything goes. Very long texts
    are judged whole. Repeated rows are judged alike; an empty table gives an empty one. All columns come back as they were, whatever their names
    (score, predicted, passages).
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = toxicity.fit(docs, labels)
    own, names = aside(docs, "text")
    return toxicity.score(own, model).where("predicted = 0").select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked at a similarity of 0.8 or more, the one with the least id stays (null ids after all others).

    Documents are told apart by id and text, so rows that share an id, or have none, are judged each by its own text. Of rows equal in
    both, one stays (that with the least hash of all its columns). Texts without words (null and empty too) have no links and all stay. Very long texts are
    compared whole; an empty table gives an empty one. All columns come back as they were, whatever their names (the join sees none but a key and the text).
    """
    key, columns = "_key", docs.columns
    docs, names = aside(docs, "doc_id", "text")
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    small = lambda df: F.broadcast(df) if df.count() <= SENT else df
    joined = ngram_jaccard_join(keyed.select(key, "text"), id_col=key)
    linked = cut(joined.where("n_links > 0").select(key, "class_id").distinct(), "linked")
    ids = keyed.select(key, "doc_id").join(small(linked.select(key)), key, "left_semi").distinct()
    stays = linked.join(ids, key).groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("s")).select("class_id", F.col(f"s.{key}").alias("stays"))
    rest = cut(linked.join(stays, "class_id").where(F.col(key) != F.col("stays")).select(key), "near_copies")
    repeated = cut(keyed.where(words).groupBy(key).count().where("count > 1").select(key), "repeated")
    kept = keyed.join(small(rest), key, "left_anti")
    if repeated.isEmpty():
        return kept.select(*names).toDF(*columns)
    least = kept.join(small(repeated), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("d")).select("d.*")
    return kept.join(small(repeated), key, "left_anti").select(*names).unionByName(least).toDF(*columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also start earlier are cut out; untouched texts stay as they are.

    Null texts stay null and empty ones empty; a text of which every word goes becomes empty. Rows stand in the order of id (null last), then of a hash of the text.
    Very long texts are read whole; an empty table gives an empty one. All columns but text and n_chars (the new text's length, where there is such a column) come back as they were, whatever
    their names (n_words, n_removed, spans, kept_text).
    """
    own, names = aside(docs, "doc_id", "text")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = substring_dedup(own).withColumn("text", text)
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(own_name).alias(c) for c, own_name in zip(docs.columns, names, strict=True)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn and repeat at most 3 times; one row per copy taken, in training order.

    Documents without words (null and empty texts) are taken 0 times and go. Null sources are a source of their own. Repeated rows each count; of rows that tie in place any
    may come first. The document in which a target ends is kept whole, very long ones too; an empty table gives an empty one. Columns travel inside one struct, so none is
    mistaken for the operator's, whatever their names (size, id, position).
    """
    own, _ = aside(docs, "doc_id", "text", "source")
    rows = mixing.sizes(own, keep=True)
    return mixing.training_order(rows, mixing.by_rule(mixing.sizes(own), (1.0, 2.0, 3.0)), 3).select("doc.*").toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids, with a check that they decode to it.

    Adds ids, n_tokens and round_trip; where documents hold a column of such a name, that one stays and the new one's name gets underscores until it is free (ids_). All columns come back as
    they were. A null text has null ids, an empty one none. Very long texts are encoded whole, repeated rows alike; an empty table gives an empty one.
    """
    own, names = aside(docs, "text")
    added = []
    for name in ("ids", "n_tokens", "round_trip"):
        while name in (*docs.columns, *added):
            name += "_"
        added.append(name)
    return encode_documents(own).select(*names, "ids", "n_tokens", "round_trip").toDF(*docs.columns, *added)


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("substring dedup", drop_repeats), ("mixing", mix_sources), ("SentencePiece", encode)]
#: Models and sampled joins take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i}")
    return docs
