"""Mixing sources to target weights by Poisson replication, in built-in DataFrame functions only.

Every source gets a mean repetition rate: its share of the target weights times the size of the mix, over the rows it
has.  A row's number of copies is the inverse of the Poisson distribution with that mean at a uniform number hashed
from the seed and the row, so a rerun, a retried task or another cluster size gives the same mix, and no count
depends on another row.  The copies are then dealt out in the order of another hash: a global shuffle.

The rates are one small row per source.  They are broadcast only after their number was checked; with more sources
than ``MAX_BROADCAST_SOURCES`` the join is left to Spark, which splits a hot source at run time.

Edge cases: null and unknown sources are sources like any other (weight ``other_weight``, by default their share of
the rows); repeated rows with one ``doc_id`` get the same count; a null ``doc_id`` hashes as the text "null"; a weight of
0 drops a source, which is the operator's meaning; a mean above ``MAX_RATE`` (a source of one or a few rows among
millions) is drawn as the sum of independent Poisson counts of equal means of at most ``MAX_RATE``, each with its own
hashed number, which is a Poisson count of the whole mean; a ``size`` that the caller gives and that needs such a mean
raises ValueError; an empty table gives an empty one; other columns are carried along,
whatever their names; only ``copy_no`` and ``mix_key`` are added (columns of these names in the
input are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.joins import packed

MAX_BROADCAST_SOURCES = 100_000
#: Production target: flatten the sources, each weighted by the square root of its rows.
TEMPERATURE = 0.5
#: The highest mean of one Poisson draw; exp(-rate) must stay a normal number.
MAX_RATE = 500.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits from the md5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, other_weight: float | None = None, temperature: float = TEMPERATURE) -> tuple[DataFrame, int]:
    """One row per source (source, n_rows, rate, parts, cdf: cumulative Poisson probabilities of rate / parts), and their
    number.

    ``weights`` are relative target shares of the mix; without them a source weighs ``n_rows ** temperature``.
    ``size`` is the expected number of rows of the mix, by default that of the input."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature))))
    else:
        given = F.lit(None).cast("double")
        for name, w in sorted(weights.items()):
            given = F.when(F.col("source") == name, F.lit(float(w))).otherwise(given)
        counts = counts.withColumn("weight", F.coalesce(given, F.lit(other_weight).cast("double"), F.col("n_rows").cast("double")))
    total = counts.agg(F.sum("weight").alias("weight"), F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_sources"), F.max(F.col("weight") / F.col("n_rows")).alias("top")).first()
    want = float(size if size is not None else total.n_rows or 0)
    scale = want / total.weight if total.weight else 0.0
    if size is not None and (total.top or 0.0) * scale > MAX_RATE:
        raise ValueError(f"a source would be repeated {total.top * scale:.0f} times on average; the most is {MAX_RATE}")
    # Beyond mean + 12 sd + 20 a count has a probability below 2**-52, the step of the uniform numbers.
    top = F.ceil(F.col("part_rate") + 12 * F.sqrt("part_rate") + 20).cast("int")
    one = counts.withColumn("rate", F.col("weight") * scale / F.col("n_rows"))
    one = one.withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")).withColumn("part_rate", F.col("rate") / F.col("parts"))
    terms = F.aggregate(
        F.sequence(F.lit(0), top),
        F.struct(F.exp(-F.col("part_rate")).alias("p"), F.lit(0.0).alias("cum"), F.array().cast("array<double>").alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("part_rate") / (k + 1)).alias("p"),
            (acc["cum"] + acc["p"]).alias("cum"),
            F.concat(acc["cdf"], F.array(acc["cum"] + acc["p"])).alias("cdf"),
        ),
    )["cdf"]
    return one.select("source", "n_rows", "rate", "parts", terms.alias("cdf")), total.n_sources


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, other_weight: float | None = None, seed: int = 17, temperature: float = TEMPERATURE, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every row repeated by its Poisson count, plus copy_no (from 1) and mix_key, in the order of
    mix_key."""
    docs = docs.drop("copy_no", "mix_key")
    rates, n_sources = source_rates(docs.select("source"), weights, size, other_weight, temperature)
    rates = rates.select(F.col("source").alias("s"), "parts", "cdf")
    if n_sources <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # The caller's columns travel in one struct: none of their names can meet one of those below.
    rows = packed(docs, id=F.col(id_col), source=F.col("source"), u=uniform(seed, F.col(id_col)))
    copies = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    draw = lambda j: uniform(seed, F.concat(F.lit("part"), j.cast("string")), F.col("id"))
    us = F.transform(F.sequence(F.lit(2), F.col("parts")), draw)
    more = F.aggregate(us, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = F.when(F.col("parts") == 1, copies).otherwise(copies + more)
    counted = rows.join(rates, F.col("source").eqNullSafe(F.col("s"))).withColumn("n", copies).where("n > 0").select("row", "id", "n")
    dealt = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = F.md5(F.concat_ws(":", F.lit(f"mix{seed}"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy_no").cast("string")))
    dealt = dealt.withColumn("mix_key", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    return dealt.orderBy("mix_key", "id", "copy_no").select("row.*", "copy_no", "mix_key")


def oracle_sql(seed: int = 17, temperature: float = TEMPERATURE, docs: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """DuckDB SQL for ``mix_sources(documents)`` with the default weights, for means of any size."""
    hashed = lambda key: f"CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) / 4503599627370496.0"
    own = "coalesce(u.doc_id::VARCHAR, 'null')"
    later = hashed(f"'{seed}:part' || j || ':' || {own}")
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temperature}) AS w FROM {docs} GROUP BY source),
means AS (SELECT source, w * ((SELECT sum(n)::DOUBLE FROM counts) / (SELECT sum(w) FROM counts)) / n AS mean FROM counts),
rates AS (SELECT source, greatest(ceil(mean / {MAX_RATE}), 1)::INT AS parts, mean / greatest(ceil(mean / {MAX_RATE}), 1) AS rate FROM means),
cdf AS (
  SELECT source, rate, parts, 0 AS k, exp(-rate) AS p, exp(-rate) AS cum FROM rates
  UNION ALL
  SELECT source, rate, parts, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM cdf
  WHERE k < CAST(ceil(rate + 12 * sqrt(rate) + 20) AS INT)),
dist AS (SELECT source, max(parts) AS parts, list(cum ORDER BY k) AS cdf FROM cdf GROUP BY source),
u AS (SELECT {columns}, {hashed(f"'{seed}:' || {own}")} AS u FROM {docs} AS u),
n AS (SELECT {", ".join("u." + c for c in columns.split(", "))}, len(list_filter(cdf, lambda c: c <= u.u))
  + coalesce(list_sum(list_transform(range(2, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <= {later})))), 0)::BIGINT AS n FROM u JOIN dist ON u.source IS NOT DISTINCT FROM dist.source),
x AS (SELECT {columns}, CAST(unnest(range(1, n + 1)) AS INT) AS copy_no FROM n)
SELECT *, CAST('0x' || substr(md5('mix{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no), 1, 15) AS BIGINT) AS mix_key FROM x"""
