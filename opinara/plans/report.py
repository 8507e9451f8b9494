"""Plain-text reports: numbered parts with source, calculation and an aligned table; empty parts are left out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.plans import catalogue

#: Rows of a table that a report shows at most; a longer result says how many it has.
SHOWN = 60


@dataclass(frozen=True)
class Part:
    title: str
    calculation: str
    query: str
    order: tuple[str, ...] = ()


PARTS = (
    Part("Absolute correlations", "mean, median, sd, extremes and skewness of |r| over topic pairs, by year", "abs_correlation_summary", ("year",)),
    Part("Example pair", "the pair of concepts whose |r| differs most offline and least online: gap offline / (gap online + 0.05)", "example_pair"),
    Part("Levels", "mean |r|, ratio to and gap from the reference year, dispersion and range, with bootstrap limits", "level_summary", ("what", "society")),
    Part("Dispersion between years", "population sd and range of yearly mean opinions", "dispersion_ratio"),
    Part("Between-topic share", "between-group over total sum of squares", "eta_squared"),
    Part("Effective dimensionality", "participation ratio, exponential and stable rank of the yearly covariance", "spectra", ("year",)),
    Part("Share of directions", "participation ratio of each year's covariance and its number of topics", "year_participation", ("year",)),
    Part("Overlap", "least, median and greatest number of users of a topic pair", "pair_overlap_counts", ("year",)),
    Part("Sample sizes", "users and posts by topic and year; users of several years count in each", "users_by_topic_year", ("topic", "year")),
    Part("Similarity-adjusted means", "density-ratio weighted mean |r| and effective sample size", "density_ratio_adjusted_mean", ("society",)),
    Part("Strata-adjusted means", "mean |r| with the reference year's strata shares", "strata_adjusted_mean", ("society",)),
    Part("Gap decomposition", "raw gap, its part due to similarity and the rest, by method, with bootstrap limits", "gap_decomposition", ("society", "method")),
    Part("Common support", "range of similarities that every year covers", "common_support"),
    Part("Similarities", "mean, sd, extremes and quartiles of the pairs' similarities", "similarity_summary", ("society",)),
    Part("Slopes", "two-sided p of the slope of |r| on similarity", "wls_p_values", ("society",)),
    Part("Ranks on the common support", "Spearman correlation of |r| and similarity", "support_spearman", ("society",)),
    Part("Re-pairing", "agreement of two years' |r| by topic against permuted topics", "repairing"),
    Part("Shapley shares", "R2 shares of society and similarity", "shapley_r2"),
    Part("Topic subsets", "ratio of two years over all pairs of three-topic subsets", "topic_subset_dispersion"),
    Part("Random topic sets", "mean |r| over all sets of three topics", "random_topic_sets"),
    Part("Every pair", "Pearson correlation with 95 % limits", "pearson_fisher_ci", ("t1", "t2")),
)


def aligned(rows: Sequence[Sequence], names: Sequence[str]) -> str:
    cells = [list(names)] + [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    width = [max(len(r[k]) for r in cells) for k in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in cells)


def section(number: int, part: Part, df: DataFrame) -> str:
    df = df.orderBy(*part.order) if part.order else df
    rows = df.limit(SHOWN + 1).collect()
    if not rows:
        return ""
    more = f"\n({df.count()} rows in all)" if len(rows) > SHOWN else ""
    return f"Part {number}. {part.title}\nSource: {part.query}\nCalculation: {part.calculation}\nResult:\n{aligned([list(r) for r in rows[:SHOWN]], df.columns)}{more}\n"


def write_sections(spark: SparkSession, sf_dir: str, folder: str, parts: Sequence[Part] = PARTS) -> list[str]:
    """Each part's table as CSV in a folder of its own; the names of the parts written.  Empty parts are left out."""
    made = []
    for p in parts:
        df = catalogue.QUERIES[p.query](spark, sf_dir)
        if df.take(1):
            plain = [F.to_json(F.col(c)).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
            df.select(*plain).write.mode("overwrite").option("header", "true").csv(f"{folder}/{p.query}")
            made.append(p.query)
    return made


def keep_sections(spark: SparkSession, folder: str, wanted: Sequence[str]) -> list[DataFrame]:
    """The tables of those sections of an older report folder that are wanted and there."""
    from opinara.sources.readers import exists

    return [spark.read.csv(f"{folder}/{q}", header=True) for q in wanted if exists(spark, f"{folder}/{q}")]


def build_report(spark: SparkSession, sf_dir: str, parts: Sequence[Part] = PARTS) -> str:
    made = (section(k + 1, p, catalogue.QUERIES[p.query](spark, sf_dir)) for k, p in enumerate(parts))
    return "\n".join(s for s in made if s)
