"""Permutations and Bayesian bootstraps of groups of any size, from hashes instead of generators.

A random number belongs to a row and a draw, not to a task, so results don't depend on the partitioning and are the same when
a task runs again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import stats
from opinara.functions.arrays import list_matrix
from opinara.operators.correlation import safe_corr
from opinara.operators.ranks import numbered
from opinara.session import cut_lineage

#: Places of a bin that one task permutes; places whose products it adds up at once; rounds of a keyed permutation.
BIN, BLOCK, ROUNDS = 1 << 17, 1 << 15, 6
#: Rows whose weights one task sums; draws of one partial sum.
WEIGHED, DRAWS = 50_000, 100
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(at: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Where keyed pseudo-random permutations of 0..n-1 send ``at``, one row for each 64-bit key: Feistel rounds on the two halves of
    a number of an even number of bits, again and again until the number is below n."""
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    with np.errstate(over="ignore"):
        rounds = mixed(keys.astype(np.uint64)[:, None] + GOLDEN * np.arange(1, ROUNDS + 1, dtype=np.uint64))
        out = np.tile(at.astype(np.uint64), len(keys))
        row = np.repeat(np.arange(len(keys)), len(at))
        open_ = np.arange(len(out))
        while len(open_):
            x, k = out[open_], rounds[row[open_]]
            left, right = x >> half, x & low
            for r in range(ROUNDS):
                left, right = right, left ^ (mixed(right ^ k[:, r]) & low)
            x = (left << half) | right
            out[open_] = x
            open_ = open_[x >= np.uint64(n)]
    return out.astype(np.int64).reshape(len(keys), len(at))


def shuffled_correlations(pairs: DataFrame, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(t1, t2, n, r, shuffled_mean, shuffled_sd): observed r of each pair of topics, and mean and sd over ``draws`` permutations of
    one side against the other, for pairs of any number of rows.

    Both sides are permuted: a draw takes one of about sqrt(``draws``) permutations of x and one of as many of y, so that all draws are
    one product of two matrices.  Each draw is a random permutation of all rows, and any two draws are as good as independent, which
    is all that a mean and an sd need.  Rows are numbered by range partitions; keyed permutations of the numbers deal either side
    into bins of ``BIN`` places, and a task permutes one bin, so that a row is copied once for each side however many there are.  (Two
    draws share the dealing and so correlate by 1 / ``BIN``.)  Nulls take no part; pairs of fewer than two rows or without spread
    have null results."""
    known = pairs.where("x is not null and y is not null").select("t1", "t2", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    known = cut_lineage(known, "pairs")
    placed = numbered(known, ["t1", "t2"], [F.col("x"), F.col("y")])
    m = known.groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2")).agg(*[f(c).alias(f"{name}{c}") for c in "xy" for name, f in (("m", F.avg), ("s", F.stddev_pop))], safe_corr(F.col("x"), F.col("y")).alias("r"))
    rows = placed.join(m, F.col("t1").eqNullSafe(F.col("k1")) & F.col("t2").eqNullSafe(F.col("k2"))).where("_size > 1 and sx > 0 and sy > 0")
    z = rows.select("t1", "t2", F.col("_size").alias("n"), (F.col("_n") - 1).cast("long").alias("i"), ((F.col("x") - F.col("mx")) / F.col("sx")).alias("zx"), ((F.col("y") - F.col("my")) / F.col("sy")).alias("zy"))
    kinds = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in ("t1", "t2"))
    side = int(np.ceil(np.sqrt(draws)))

    def base(t1, t2) -> int:
        return zlib.crc32(f"{t1}_{t2}".encode()) << 32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pa.table({"t1": b["t1"], "t2": b["t2"]}).group_by(["t1", "t2"]).aggregate([]).to_pylist()
            for k in names:
                own = b.filter(pc.and_(*(pc.equal(b[c], k[c]) if k[c] is not None else pc.is_null(b[c]) for c in ("t1", "t2"))))
                n = own["n"][0].as_py()
                keys = np.arange(2, dtype=np.uint64) + np.uint64(base(k["t1"], k["t2"]) + (seed << 20))
                for side_, (to, name) in enumerate(zip(permuted(own["i"].to_numpy(), n, keys), ("zx", "zy"), strict=True)):
                    yield pa.RecordBatch.from_arrays([own["t1"], own["t2"], pa.array(to // BIN), pa.array(to % BIN), pa.array(np.full(len(to), side_, np.int32)), own[name], own["n"]], names=["t1", "t2", "bin", "at", "side", "z", "n"])

    dealt = z.mapInArrow(deal, f"{kinds}, bin long, at long, side int, z double, n long")
    # As many tasks as cores at least: the rows are few, the work is in the draws.
    dealt = dealt.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "t1", "t2", "bin")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t1, t2, at_bin = (k.as_py() for k in key)
        sides, at, z = (t[c].to_numpy() for c in ("side", "at", "z"))
        values = []
        for k in (0, 1):
            own = np.flatnonzero(sides == k)
            values.append(z[own[np.argsort(at[own])]])
        size = len(values[0])
        # Permutations of this bin's places, from generators of their own.
        orders = [np.stack([np.random.default_rng([base(t1, t2) >> 32, seed, at_bin, k, d]).permutation(size).astype(np.int32) for d in range(side)]) for k in (0, 1)]
        out = np.zeros((side, side))
        for s in range(0, size, BLOCK):
            x, y = (v[o[:, s : s + BLOCK]] for v, o in zip(values, orders, strict=True))
            out += x @ y.T
        return pa.table({"t1": pa.array([t1], t.schema.field("t1").type), "t2": pa.array([t2], t.schema.field("t2").type), "sums": pa.array([(out.ravel()[:draws] / t["n"][0].as_py()).tolist()], pa.list_(pa.float64()))})

    sums = dealt.groupBy("t1", "t2", "bin").applyInArrow(run, f"{kinds}, sums array<double>")
    each = sums.select("t1", "t2", F.posexplode("sums").alias("draw", "s")).groupBy("t1", "t2", "draw").agg(F.sum("s").alias("s"))
    found = each.groupBy(F.col("t1").alias("d1"), F.col("t2").alias("d2")).agg(F.avg("s").alias("shuffled_mean"), F.stddev_pop("s").alias("shuffled_sd"))
    size = known.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    both = F.col("sx").isNotNull() & (F.col("sx") > 0) & (F.col("sy") > 0)
    table = size.join(m, F.col("t1").eqNullSafe(F.col("k1")) & F.col("t2").eqNullSafe(F.col("k2"))).withColumn("r", F.when(both & (F.col("n") > 1), F.col("r")))
    table = table.join(found, F.col("t1").eqNullSafe(F.col("d1")) & F.col("t2").eqNullSafe(F.col("d2")), "left")
    return table.select("t1", "t2", "n", "r", "shuffled_mean", "shuffled_sd")


def exponentials(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Exp(1) numbers for rows (64-bit keys) x draws, each from a hash of both; normalised, they are Dirichlet(1, ..., 1)."""
    with np.errstate(over="ignore"):
        bits = mixed(mixed(keys.astype(np.uint64))[:, None] + GOLDEN * (draws.astype(np.uint64) + np.uint64(1))[None])
    return -np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)


def weighted_centroid_draws(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """(source, topic, block, sums): for blocks of ``DRAWS`` draws, the sums over a topic's words of weight * Exp(1) * vector."""
    salts = F.greatest(F.ceil(F.col("_n") / WEIGHED), F.lit(1)).cast("int")
    sizes = rows.groupBy("source", "topic").agg(F.count(F.lit(1)).alias("_n")).select("source", "topic", salts.alias("_salts"))
    key = F.xxhash64(F.lit(seed), "source", "topic", "word")
    dealt = rows.join(F.broadcast(sizes), ["source", "topic"]).select("source", "topic", key.alias("key"), F.pmod(F.xxhash64("word"), F.col("_salts")).alias("salt"), F.col("vector").cast("array<double>").alias("vector"), F.col("weight").cast("double").alias("weight"))
    kinds = dict(rows.dtypes)

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        v = list_matrix(t["vector"].chunk(0)) * t["weight"].to_numpy()[:, None]
        key = t["key"].to_numpy().view(np.uint64)
        out = [(exponentials(key, np.arange(s, min(s + DRAWS, draws))).T @ v).ravel() for s in range(0, draws, DRAWS)]
        n = len(out)
        return pa.table({"source": pa.array([keys[0].as_py()] * n, t.schema.field("source").type), "topic": pa.array([keys[1].as_py()] * n, t.schema.field("topic").type), "block": pa.array(range(n), pa.int32()), "sums": pa.array([x.tolist() for x in out], pa.list_(pa.float64()))})

    return dealt.groupBy("source", "topic", "salt").applyInArrow(run, f"source {kinds['source']}, topic {kinds['topic']}, block int, sums array<double>")


def rank_differences(rows: DataFrame, a: str, b: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(measure, difference, lo, hi): semantic PR and eRank of source ``a`` minus those of ``b``, with 95 % limits of a Bayesian bootstrap.

    ``rows`` is (source, topic, word, vector, weight) with one row for each word of a topic.  In every draw each word's weight is
    multiplied by its own Exp(1) number (Dirichlet weights up to a factor that the unit centroids lose); the ranks are those of
    the topics' unit centroids.  Any number of words: tasks sum at most about ``WEIGHED`` of them; null vectors or weights take no part."""
    spark = rows.sparkSession
    known = rows.where(F.col("source").isin(a, b)).where("vector is not null and weight is not null")
    drawn = weighted_centroid_draws(known, draws, seed)

    def numbers(centroids: np.ndarray) -> tuple[float, float]:
        unit = centroids / np.linalg.norm(centroids, axis=1, keepdims=True)
        s = stats.spectrum(unit @ unit.T)
        return s["pr"], s["erank"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        """One block of draws: all topics of both sources, a bounded number of sums of each."""
        t = t.combine_chunks()
        x = list_matrix(t["sums"].chunk(0))
        n = min(DRAWS, draws - key[0].as_py() * DRAWS)
        source, topic = np.array(t["source"].to_pylist()), np.array(t["topic"].to_pylist())
        out: list[tuple[float, float]] = []
        sides = []
        for s in (a, b):
            names, at = np.unique(topic[source == s], return_inverse=True)
            sums = np.zeros((len(names), x.shape[1]))
            np.add.at(sums, at, x[source == s])
            sides.append(sums.reshape(len(names), n, -1))
        for d in range(n):
            (p, e), (q, f) = (numbers(s[:, d]) for s in sides)
            out.append((p - q, e - f))
        return pa.table({"pr": [o[0] for o in out], "erank": [o[1] for o in out]})

    found = drawn.groupBy("block").applyInArrow(run, "pr double, erank double")
    limits = found.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{k}") for c in ("pr", "erank") for k, q in (("lo", 0.025), ("hi", 0.975))])
    centroid = known.select("source", "topic", F.posexplode("vector").alias("pos", "v"), "weight").groupBy("source", "topic", "pos").agg((F.sum(F.col("v").cast("double") * F.col("weight")) / F.sum("weight")).alias("c"))
    square = centroid.groupBy("source", "topic").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("c")).select("source", "topic", "c.c").collect()  # topics
    plain = [numbers(np.array([r.c for r in square if r.source == s])) for s in (a, b)]
    differ = spark.createDataFrame([("pr", plain[0][0] - plain[1][0]), ("erank", plain[0][1] - plain[1][1])], "measure string, difference double")
    lo = F.when(F.col("measure") == "pr", F.col("pr_lo")).otherwise(F.col("erank_lo"))
    hi = F.when(F.col("measure") == "pr", F.col("pr_hi")).otherwise(F.col("erank_hi"))
    return differ.join(F.broadcast(limits)).select("measure", "difference", lo.alias("lo"), hi.alias("hi"))  # one row

