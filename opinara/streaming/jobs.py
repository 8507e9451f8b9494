"""Batch jobs that may be run again at any time: a control table says how far each batch has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states of a batch, in order.
STATES = ("generated", "submitted", "retrieved")


def advance(control: DataFrame, requests: DataFrame, submitted: DataFrame, outputs: DataFrame) -> DataFrame:
    """(batch, state, requests, answered): the state of each batch from what is there: its requests (batch, custom_id), the
    batches submitted (batch) and the answers (custom_id).  States never go back from those of ``control`` (batch, state),
    and a batch is retrieved when all its requests have an answer."""
    own = requests.select("batch", "custom_id").distinct()
    done = own.join(outputs.select("custom_id").distinct().withColumn("_a", F.lit(1)), "custom_id", "left")
    counts = done.groupBy("batch").agg(F.count(F.lit(1)).alias("requests"), F.count("_a").alias("answered"))
    sent = submitted.select("batch").distinct().withColumn("_s", F.lit(True))
    level = F.when(F.col("answered") == F.col("requests"), 2).when(F.col("_s"), 1).otherwise(0)
    before = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state")) - 1, F.lit(-1))
    joined = counts.join(sent, "batch", "left").join(control.select("batch", "state"), "batch", "left")
    now = F.greatest(level, before).cast("int")
    return joined.select("batch", F.element_at(F.array(*[F.lit(s) for s in STATES]), now + 1).alias("state"), "requests", "answered")


def open_requests(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """Requests without an answer yet: what a run that starts again still has to send."""
    return requests.join(outputs.select("custom_id").distinct(), "custom_id", "left_anti")


def score_rows(rows: DataFrame, text: str, scorer, key: str = "post_id", batch: int = 512) -> DataFrame:
    """(key, relevance, opinion) by a scorer: a function from a list of texts to (relevance logits, opinions), called for
    ``batch`` texts at a time.  Opinions of texts that aren't relevant are null."""
    kind = dict(rows.dtypes)[key]

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for s in range(0, len(f), batch):
                part = f.iloc[s : s + batch]
                logits, opinions = scorer(part[text].fillna("").tolist())
                relevant = np.asarray(logits).argmax(1)
                yield pd.DataFrame({key: part[key], "relevance": relevant, "opinion": [float(o) if r == 1 else None for o, r in zip(opinions, relevant, strict=True)]})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, relevance int, opinion double")
