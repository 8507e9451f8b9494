"""Rater labels: majority, agreement, kappa, samples for labelling and for training, classifier metrics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.ranks import numbered, running_sums

IRRELEVANT = -99


def valid_labels(column: Column, allowed: Sequence[int] = (-2, -1, 0, 1, 2, IRRELEVANT)) -> Column:
    return F.when(column.isin(list(allowed)), column)


def merge_raters(tables: Sequence[tuple[str, DataFrame]], carry: Sequence[str] = ()) -> DataFrame:
    """Outer merge of raters' labels (post_id, label), one column each, as one aggregate instead of a chain of joins.

    ``carry``: columns of the first rater's table (texts, say) that go along; null for posts that it lacks.  Of several rows of
    a rater for one post the greatest label counts, and the greatest value of each carried column."""
    parts = None
    for i, (name, t) in enumerate(tables):
        own = [F.col(c) if i == 0 else F.lit(None).cast(tables[0][1].schema[c].dataType).alias(c) for c in carry]
        part = t.select("post_id", F.lit(name).alias("_rater"), F.col("label"), *own)
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("post_id").agg(*[F.max(F.when(F.col("_rater") == n, F.col("label"))).alias(n) for n, _ in tables], *[F.max(c).alias(c) for c in carry])


def majority(rows: DataFrame, raters: Sequence[str]) -> DataFrame:
    """agreement_count (most equal labels) and agreement_value (their label if more than one; the least on ties)."""
    labels = F.filter(F.array(*raters), lambda v: v.isNotNull())
    counts = F.transform(F.array_distinct(labels), lambda v: F.struct(F.size(F.filter(labels, lambda u: u == v)).alias("n"), (-v).alias("minus")))
    best = F.array_max(counts)
    return rows.withColumn("agreement_count", F.coalesce(best["n"], F.lit(0))).withColumn("agreement_value", F.when(best["n"] > 1, -best["minus"]))


def agreement_table(rows: DataFrame, raters: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Labelled posts, valid labels per rater, shares of agreement of two and of three, label counts."""
    m = majority(rows, raters)
    aggs = [F.count(F.lit(1)).alias("labelled"), *[F.count(r).alias(f"valid_{r}") for r in raters], F.avg((F.col("agreement_count") >= 2).cast("double")).alias("agree_2plus"), F.avg((F.col("agreement_count") >= 3).cast("double")).alias("agree_3plus")]
    aggs += [F.count_if(F.col("agreement_value") == v).alias(f"label_{str(v).replace('-', 'm')}") for v in (-2, -1, 0, 1, 2)] + [F.count_if(F.col("agreement_value") == IRRELEVANT).alias("irrelevant")]
    return m.groupBy(*by).agg(*aggs) if by else m.agg(*aggs)


def cohen_kappa(rows: DataFrame, raters: Sequence[str]) -> DataFrame:
    """(rater_1, rater_2, n, agreement, kappa) of each pair of raters; null kappa when chance agreement is 1."""
    out = None
    for a, b in combinations(raters, 2):
        both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
        long = both.select(F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("label"), "n"), F.struct(F.lit("y").alias("side"), F.col("y").alias("label"), "n"))).alias("v"))
        margins = long.select("v.*").groupBy("label").agg(F.sum(F.when(F.col("side") == "x", F.col("n")).otherwise(0)).alias("nx"), F.sum(F.when(F.col("side") == "y", F.col("n")).otherwise(0)).alias("ny"))
        chance = margins.agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("e"))
        total = both.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
        row = total.join(chance).select(F.lit(a).alias("rater_1"), F.lit(b).alias("rater_2"), "n", (F.col("same") / F.col("n")).alias("agreement"), (F.col("e") / F.col("n") / F.col("n")).alias("pe"))
        row = row.select("rater_1", "rater_2", "n", "agreement", F.try_divide(F.col("agreement") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))
        out = row if out is None else out.unionAll(row)
    return out


def stratified_sample(rows: DataFrame, strata: Sequence[str], size: int, order: Sequence[Column]) -> DataFrame:
    """About ``size`` rows, the same share of each stratum (rounded up): those first in ``order``."""
    total = rows.count()
    share = min(1.0, size / total) if total else 0.0
    return numbered(rows, strata, order).where(F.col("_n") <= F.ceil(F.col("_size") * F.lit(share))).drop("_n", "_size")


def quota_sample(rows: DataFrame, label: str, size: int, order: Sequence[Column], least: int = 10, irrelevant: int = 40) -> DataFrame:
    """A validation sample: ``irrelevant`` irrelevant rows, the rest in proportion to the labels, each label at least
    ``least`` rows or all it has."""
    n_other = rows.where((F.col(label) != IRRELEVANT) & F.col(label).isNotNull()).count()
    quota = F.when(F.col(label) == IRRELEVANT, F.lit(irrelevant)).otherwise(F.greatest(F.lit(least), F.floor(F.col("_size") * F.lit((size - irrelevant) / max(n_other, 1)))))
    return numbered(rows.where(F.col(label).isNotNull()), [label], order).where(F.col("_n") <= quota).drop("_n", "_size")


def split_sets(rows: DataFrame, label: str, order: Sequence[Column], shares: tuple[float, float] = (0.6, 0.2), least: int = 10) -> DataFrame:
    """``split`` (train, validate, test) by share within each label; labels of fewer than ``least`` rows are repeated
    until they have that many."""
    n = numbered(rows, [label], order)
    n = n.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.lit(least) / F.col("_size")).cast("int")))))
    n = n.where((F.col("_size") >= least) | ((F.col("_copy") - 1) * F.col("_size") + F.col("_n") <= least))
    total = F.greatest(F.col("_size"), F.lit(least))
    place = (F.col("_copy") - 1) * F.col("_size") + F.col("_n")
    split = F.when(place <= F.floor(total * shares[0]), "train").when(place <= F.floor(total * (shares[0] + shares[1])), "validate").otherwise("test")
    return n.withColumn("split", split).drop("_n", "_size", "_copy")


def relevance_target(label: Column) -> Column:
    return F.when(label.between(-2, 2), 1).otherwise(0)


def classifier_metrics(rows: DataFrame, truth: str, predicted: str, score: str | None = None) -> DataFrame:
    """accuracy, precision, recall, f1, label AUC and, with ``score``, probability AUC by rank sums of score counts."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    tp, fp, fn, tn = (F.count_if(c) for c in (t & p, ~t & p, t & ~p, ~t & ~p))
    base = rows.agg(F.count(F.lit(1)).alias("n"), ((tp + tn) / F.count(F.lit(1))).alias("accuracy"), F.try_divide(tp.cast("double"), tp + fp).alias("precision"), F.try_divide(tp.cast("double"), tp + fn).alias("recall"), F.try_divide(2.0 * tp, 2 * tp + fp + fn).alias("f1"), ((F.try_divide(tp.cast("double"), tp + fn) + F.try_divide(tn.cast("double"), tn + fp)) / 2).alias("label_auc"))
    if score is None:
        return base
    per = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    below = running_sums(per, [], ["s"], "neg", "below", inclusive=False)
    auc = below.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
    return base.join(auc)


def label_table(rows: DataFrame, raters: Sequence[str], by: str) -> DataFrame:
    """Per topic: labelled posts, posts that two raters agree on (the training rows), their share that is relevant, the
    histogram of agreed labels, and each two raters' agreement."""
    m = majority(rows, raters)
    agreed = F.col("agreement_count") >= 2
    value = F.col("agreement_value")
    aggs = [F.count(F.lit(1)).alias("labelled"), F.count_if(agreed).alias("training_rows"), F.avg(agreed.cast("double")).alias("agree_2plus"), F.try_divide(F.count_if(agreed & (value != IRRELEVANT)).cast("double"), F.count_if(agreed)).alias("relevant_share")]
    aggs += [F.count_if(value == v).alias(f"label_{str(v).replace('-', 'm')}") for v in (-2, -1, 0, 1, 2)]
    aggs += [F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"same_{a}_{b}") for a, b in combinations(raters, 2)]
    return m.groupBy(by).agg(*aggs)


def training_target(rows: DataFrame, count: str, value: str, task: str) -> DataFrame:
    """Rows that two raters agree on with ``target``: relevance 0 or 1, or, for the regression, the label of relevant ones."""
    kept = rows.where(F.col(count) >= 2)
    if task == "relevance":
        return kept.withColumn("target", relevance_target(F.col(value)))
    if task == "opinion":
        return kept.where(F.col(value) != IRRELEVANT).withColumn("target", F.col(value))
    raise ValueError(f"unknown task {task!r}")


def attach_answers(posts: DataFrame, answers: DataFrame, parse) -> DataFrame:
    """Posts that a model answered, with the opinion parsed from its answer (answers: post_id, content); one answer a
    post, the first in order of its text."""
    parsed = answers.where("content is not null").groupBy("post_id").agg(F.min("content").alias("content")).select("post_id", parse(F.col("content")).alias("opinion"))
    return posts.join(parsed, "post_id")


def answer_counts(answers: DataFrame, parse) -> DataFrame:
    """How many answers there are, how many could be read, how many are irrelevant, and the opinions' histogram."""
    o = answers.select(parse(F.col("content")).alias("o"))
    return o.agg(F.count(F.lit(1)).alias("answers"), F.count("o").alias("read"), F.count_if(F.col("o") == IRRELEVANT).alias("irrelevant"), *[F.count_if(F.col("o") == v).alias(f"opinion_{str(v).replace('-', 'm')}") for v in (-2, -1, 0, 1, 2)])


def user_stance(labelled: DataFrame) -> DataFrame:
    """Each user's mean opinion over relevant labelled posts, and their number."""
    ok = labelled.where(F.col("opinion").isNotNull() & (F.col("opinion") != IRRELEVANT))
    return ok.groupBy("user_id").agg(F.count(F.lit(1)).alias("posts"), F.avg("opinion").alias("stance"))


def union_samples(samples: dict[str, DataFrame]) -> DataFrame:
    """Samples of several topics as one table with a topic column; columns that a sample lacks are null."""
    out = None
    for topic, s in samples.items():
        part = s.withColumn("topic", F.lit(topic))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def run_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Number, mean and sample deviation of each metric over repeated runs; metrics without any value are left out."""
    have = runs.agg(*[F.count(m).alias(m) for m in metrics]).first()
    kept = [m for m in metrics if have[m]]
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), *[f(m).alias(f"{m}_{n}") for m in kept for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def rmse(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(predicted), 2))).alias("rmse"))
