"""Bounded samples of labelled rows for the classifiers of this subpackage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod))


def held_out(doc_id: Column, mod: int, value: int) -> Column:
    return F.coalesce(remainder(doc_id, mod) == value, F.lit(False))


def sample_labels(labels: DataFrame, label: str, per_class: int, mod: int, value: int) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` training rows of each class 0 and 1, those of the smallest hashes.

    A hash threshold first leaves about twice as many, so that the top-k that follows gathers few rows whatever the size
    of the table; the sample's size is bounded by the parameter alone.  Ids with several labels count once,
    by their highest label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), mod, value)).select("doc_id", F.col(label).cast("int").alias("label"))
    size = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    share = {k: min(1.0, (2 * per_class + 1000) / max(size.get(k, 0), 1)) for k in (0, 1)}
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("label") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    rows = rows.where(near)
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id").agg(F.max("label").alias("label"))


def one_text_each(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., text): of the rows of each key the text of the smallest hash, so that as many rows remain as there are keys."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select(*keys, "x.text")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, mod: int, value: int) -> DataFrame:
    """(doc_id, text, label) of the sampled ids, one row for each: at most 2 * per_class rows, however often an id is repeated.

    The sample of ids is broadcast."""
    sample = sample_labels(labels, label, per_class, mod, value)
    found = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return one_text_each(found, "doc_id", "label").select("doc_id", "text", "label")
