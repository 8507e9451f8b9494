"""Density curves and local lines over groups of any number of rows, by sums that tasks make of their own rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.ranks import few, numbered
from opinara.session import cut_lineage

#: Every so many rows of a sorted group one is kept, to tell nearly where a window begins.
EVERY = 1024


def density_curve(rows: DataFrame, group: str, value: str, points: int = 50, weight: str | None = None, bins: int = 4096) -> DataFrame:
    """(group, x, density): (weighted) Gaussian kernel densities by Scott's rule at ``points`` places from least to largest value.

    Linear binning shares each value between the two nearest of ``bins`` + 1 grid places, in one aggregate; the kernel then meets
    the grid's masses instead of the values.  With d the width of a bin and h the kernel's, a density is off by at most
    (d / h) ** 2 / 8 of the kernel's height 1 / (h * sqrt(2 * pi)).  Nulls and weights that are not positive take no part; groups without
    spread have no curve."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    v = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"), w.alias("w")).where("x is not null and not isnan(x) and w > 0")
    s = v.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("w")).alias("w2"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")).where("hi > lo")
    s = few(cut_lineage(s, "means"))
    off = F.col("x") - F.col("m")
    spread = v.join(s, "g").groupBy("g").agg(F.sum(F.col("w") * off * off).alias("ss"))
    one = F.col("w2") / (F.col("w1") * F.col("w1"))  # one over the effective number of rows
    s = s.join(spread, "g").withColumn("h2", F.col("ss") / F.col("w1") / (1 - one) * F.pow(one, F.lit(0.4)))
    s = s.select("g", "lo", "hi", "w1", "h2", ((F.col("hi") - F.col("lo")) / bins).alias("d")).where("h2 > 0")
    s = few(cut_lineage(s, "groups"))
    at = (F.col("x") - F.col("lo")) / F.col("d")
    left = F.least(F.floor(at), F.lit(bins - 1))
    share = at - left
    binned = v.join(s, "g").select("g", F.explode(F.array(F.struct(left.alias("b"), (F.col("w") * (1 - share)).alias("m")), F.struct((left + 1).alias("b"), (F.col("w") * share).alias("m")))).alias("p"))
    mass = binned.groupBy("g", F.col("p.b").alias("b")).agg(F.sum("p.m").alias("mass"))
    placed = mass.join(s, "g").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
    place = F.col("lo") + F.col("j") * (F.col("hi") - F.col("lo")) / (points - 1)
    u = place - (F.col("lo") + F.col("b") * F.col("d"))
    curve = placed.groupBy("g", "j").agg(F.first(place).alias("x"), (F.sum(F.col("mass") * F.exp(-u * u / (2 * F.col("h2")))) / F.first(F.col("w1") * F.sqrt(2 * np.pi * F.col("h2")))).alias("density"))
    return curve.select(F.col("g").alias(group), "x", "density")


def local_lines(rows: DataFrame, by: str, x: str, y: str, weights: dict[str, str | None], spans: Sequence[float], points: int = 25) -> DataFrame:
    """(by, span, fit, x, value): local-linear curves of y on x at ``points`` places from the least to the largest x.

    A place's line is fitted to the ceil(span * n) nearest rows, at least 3, by tricube weights up to just beyond the farthest of
    them, times the row's own weight; ``weights`` names the fits and their weight columns (None: equal weights).

    The nearest k rows of a place are a window of the rows sorted by x: it begins after all rows l with
    x[l] + x[l + k] < 2 * place.  So rows are sorted and numbered once (by range partitions).  These sums never fall, so every
    ``EVERY``-th row, with one up to as many rows beyond l + k, tells within 2 * ``EVERY`` rows where a window begins, and only the
    rows there and k rows on are met one by one.  All fits of all spans are five sums over the rows of each window.  Rows with a
    null x or y take no part, nor in a fit those without its weight; a line without spread in x is level."""
    names = list(weights)
    own = [(F.lit(1.0) if c is None else F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"w{k}") for k, c in enumerate(weights.values())]
    known = rows.select(F.col(by).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *own).where("x is not null and y is not null")
    # Where many rows share x and y, their weights spread them over the range partitions.
    order = [F.col("x"), F.col("y"), *[F.col(f"w{k}") for k, c in enumerate(weights.values()) if c is not None]]
    placed = numbered(known, ["g"], order).withColumnsRenamed({"_n": "i", "_size": "n"})
    coarse = cut_lineage(placed.where(((F.col("i") - 1) % EVERY == 0) | (F.col("i") == F.col("n"))).select("g", "x", "i", "n"), "coarse")
    ends = coarse.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("n").alias("n"))
    step = F.when(F.lit(points) > 1, (F.col("hi") - F.col("lo")) / max(points - 1, 1)).otherwise(F.lit(0.0))
    every = F.explode(F.array(*[F.lit(float(s)) for s in spans]))
    places = ends.select("g", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda j: F.col("lo") + j * step)).alias("j", "p")).select("*", every.alias("span"))
    k = F.least(F.col("n"), F.greatest(F.lit(3), F.ceil(F.col("span") * F.col("n")))).cast("long")
    places = cut_lineage(places.withColumn("k", k), "places")
    place = ["g", "span", "j"]
    ks = few(cut_lineage(places.select("g", "span", "k").distinct(), "counts"))
    beyond = coarse.select(F.col("g").alias("g2"), F.col("i").alias("i2"), F.col("x").alias("x2"))
    steps = coarse.select("g", "i", "x").join(ks, "g").join(beyond, (F.col("g") == F.col("g2")) & (F.col("i") + F.col("k") - F.col("k") % EVERY + EVERY == F.col("i2")))
    before = steps.select("g", "span", "i", (F.col("x") + F.col("x2")).alias("t")).join(few(places).select(*place, "p"), ["g", "span"])
    sure = before.where(F.col("t") < 2 * F.col("p")).groupBy(*place).agg(F.max("i").alias("least"))
    near = cut_lineage(places.join(sure, place, "left").withColumn("least", F.coalesce("least", F.lit(1 - EVERY))), "near")
    sought = near.select(*place, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("least").alias("at")), F.struct(F.lit(1).alias("side"), (F.col("least") + F.col("k")).alias("at")))).alias("s"))
    sought = few(cut_lineage(sought.select(*place, "s.side", "s.at"), "sought"))
    fine = placed.select("g", "x", "i").join(sought, "g").where((F.col("i") >= F.col("at")) & (F.col("i") <= F.col("at") + 2 * EVERY))
    fine = fine.groupBy(*place, (F.col("i") - F.col("at")).alias("o")).agg(*[F.max(F.when(F.col("side") == side, F.col("x"))).alias(c) for side, c in enumerate(("xl", "xr"))])
    fine = cut_lineage(fine, "fine")
    # In l = least + o, xl is x[l] and xr is x[l + k].
    found = fine.join(near.select(*place, "p", "least"), place).where(F.col("xl") + F.col("xr") < 2 * F.col("p"))
    skip = found.groupBy(*place).agg(F.max("o").alias("last"))
    windows = near.join(skip, place, "left").withColumn("last", F.coalesce("last", -F.col("least")))
    begun = F.col("o") == F.col("last") + 1
    windows = fine.join(windows, place).where(begun | (F.col("o") == F.col("last"))).groupBy(*place, "p").agg(F.max(F.when(begun, F.col("xl"))).alias("xl"), F.max(F.when(~begun, F.col("xr"))).alias("xr"))
    reach = F.greatest(F.col("p") - F.col("xl"), F.col("xr") - F.col("p")) * 1.0001  # fixed value: just beyond the farthest
    windows = cut_lineage(windows.select(*place, "p", F.when(reach > 0, reach).otherwise(F.lit(1.0)).alias("h")), "windows")
    u = F.col("x") - F.col("p")
    inside = placed.join(few(windows), "g").where(F.abs(u) < F.col("h"))
    ratio = F.abs(u) / F.col("h")
    kernel = (1 - ratio * ratio * ratio) * (1 - ratio * ratio * ratio) * (1 - ratio * ratio * ratio)

    def sums(w: Column, c: int) -> list[Column]:
        v = kernel * w
        return [F.sum(v * t).alias(f"{name}{c}") for name, t in (("a", F.lit(1.0)), ("b", u), ("c", u * u), ("d", F.col("y")), ("e", u * F.col("y")))]

    found = inside.groupBy("g", "span", "j", "p").agg(*[s for c in range(len(names)) for s in sums(F.col(f"w{c}"), c)])
    fits = []
    for c, name in enumerate(names):
        m0, m1, m2, t0, t1 = (F.col(f"{m}{c}") for m in "abcde")
        det = m0 * m2 - m1 * m1
        line = F.when(m0 <= 0, F.lit(None).cast("double")).when(det > 1e-12 * F.greatest(m0 * m2, F.lit(1e-300)), (m2 * t0 - m1 * t1) / det).otherwise(t0 / m0)
        fits.append(F.struct(F.lit(name).alias("fit"), line.alias("value")))
    return found.select("g", "span", "p", F.explode(F.array(*fits)).alias("f")).select(F.col("g").alias(by), "span", F.col("f.fit").alias("fit"), F.col("p").alias("x"), F.col("f.value").alias("value"))
