"""Queries of the robustness studies: all topic sets, permutations, bootstraps, curves with and without weights.

Same conventions as in ``catalogue``; each query has its SQL unless its numbers come from random draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators import adjustment, correlation, curves, places, reliability, resampling, simulation, spectral, subsets, subspaces
from opinara.plans.catalogue import _KDE, PAIRS, q6, query, rounded, society_pairs, the_pairs
from opinara.sources import adapters as ad


# --- all topic sets ---------------------------------------------------------------------------------------------------
def _parts(mod: int) -> str:
    return (
        f"op AS (SELECT o_custkey AS user_id, r_name AS society, lpad(CAST(p_size % {mod} AS VARCHAR), 2, '0') AS topic, avg(l_discount) AS off_, avg(l_quantity) AS on_ "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), "
        "co AS (SELECT a.society, a.topic AS t1, b.topic AS t2, round(abs(corr(a.off_, b.off_)), 9) AS off_, round(abs(corr(a.on_, b.on_)), 9) AS on_ FROM op a JOIN op b ON a.user_id = b.user_id AND a.society = b.society AND a.topic < b.topic GROUP BY ALL)"
    )


def part_opinions(spark, sf, mod: int) -> DataFrame:
    """(user_id, society, topic, off, on): customers' mean discount and quantity by group of part sizes, with their region."""
    t = lambda name: ad.table(spark, sf, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    topic = F.lpad((F.col("p_size") % mod).cast("string"), 2, "0")
    return rows.groupBy(F.col("o_custkey").alias("user_id"), F.col("r_name").alias("society"), topic.alias("topic")).agg(F.avg("l_discount").alias("off"), F.avg("l_quantity").alias("on"))


def part_correlations(spark, sf, mod: int, medium: str) -> DataFrame:
    """(society, t1, t2, y): absolute correlations of the topics of ``part_opinions`` in one medium."""
    values = part_opinions(spark, sf, mod).select("user_id", "society", "topic", F.col(medium).alias("value"))
    found = correlation.pairwise(correlation.topic_pairs(values, ("user_id", "society")), ("society",))
    return found.select("society", "t1", "t2", F.round(F.abs("r"), 9).alias("y"))


def _names(n: int) -> list[str]:
    return [f"{k:02d}" for k in range(n)]


def _sets(n: int, size: int, value: str) -> str:
    return (
        f"ms AS (SELECT m, row_number() OVER (ORDER BY list_filter(range({n}), lambda b: (m >> b) & 1 = 1)) - 1 AS subset FROM (SELECT unnest(range(1 << {n})) AS m) WHERE bit_count(m) = {size}), "
        f"sm AS (SELECT society, subset, count({value}) AS pairs, avg({value}) AS mean FROM co JOIN ms ON (m >> t1::INT) & 1 = 1 AND (m >> t2::INT) & 1 = 1 GROUP BY ALL)"
    )


@query("all_topic_sets", f"WITH {_parts(15)}, {_sets(15, 9, 'off_')} SELECT society, subset, pairs, {q6('mean')} AS mean FROM sm WHERE pairs = 36")
def all_topic_sets(spark, sf):
    """Mean |r| of every set of nine of the fifteen topics of each region: 5,005 sets a region."""
    return rounded(subsets.subset_means(part_correlations(spark, sf, 15, "off"), _names(15), 9, complete=True), "mean")


_GAPS = [("AMERICA", "ASIA"), ("EUROPE", "ASIA")]


@query(
    "topic_set_gaps",
    f"WITH {_parts(15)}, {_sets(15, 9, 'off_')}, g AS (SELECT x.society AS a, y.society AS b, abs(x.mean - y.mean) AS gap FROM sm x JOIN sm y ON (x.society, y.society) IN (('AMERICA', 'ASIA'), ('EUROPE', 'ASIA')) WHERE x.pairs = 36 AND y.pairs = 36) "
    f"SELECT a, b, count(*) AS combinations, {q6('avg(gap)')} AS mean_gap, {q6('min(gap)')} AS min_gap, {q6('max(gap)')} AS max_gap, {q6('avg((gap < 0.0051234)::INT)')} AS below_low, {q6('avg((gap < 0.0201234)::INT)')} AS below_high FROM g GROUP BY ALL",
)
def topic_set_gaps(spark, sf):
    """Gaps between the means of all sets of two regions, 25 million combinations each, from merges of sorted means."""
    means = subsets.subset_means(part_correlations(spark, sf, 15, "off"), _names(15), 9, complete=True)
    marks = {pair: (0.0051234, 0.0201234) for pair in _GAPS}
    found = subsets.set_gaps(means, _GAPS, marks)
    found = found.select("a", "b", "combinations", "mean_gap", "min_gap", "max_gap", F.col("below")[0].alias("below_low"), F.col("below")[1].alias("below_high"))
    return rounded(found, "mean_gap", "min_gap", "max_gap", "below_low", "below_high")


_DISPERSION = ("combinations", "off_median", "off_min", "on_median", "on_max", "ratio_median", "ratio_p5", "ratio_min", "share_above_1", "share_overlap")


@query(
    "society_set_dispersion",
    f"WITH {_parts(9)}, z AS (SELECT society, t1, t2, atanh(least(off_, 1-1e-12)) AS zoff, atanh(least(on_, 1-1e-12)) AS zon FROM co), ms AS (SELECT unnest(range(512)) AS m), "
    "sm AS (SELECT society, m, avg(zoff) AS off_, avg(zon) AS on_ FROM z JOIN ms ON bit_count(m) = 7 AND (m >> t1::INT) & 1 = 1 AND (m >> t2::INT) & 1 = 1 GROUP BY ALL), "
    "g AS (SELECT list_stddev_pop([a.off_, b.off_, c.off_]) AS off_, list_stddev_pop([a.on_, b.on_, c.on_]) AS on_ FROM sm a, sm b, sm c WHERE a.society = 'AMERICA' AND b.society = 'ASIA' AND c.society = 'EUROPE'), r AS (SELECT *, off_/on_ AS ratio, max(on_) OVER () AS most FROM g) "
    f"SELECT count(*) AS combinations, {q6('median(off_)')} AS off_median, {q6('min(off_)')} AS off_min, {q6('median(on_)')} AS on_median, {q6('max(on_)')} AS on_max, {q6('median(ratio)')} AS ratio_median, {q6('quantile_cont(ratio, 0.05)')} AS ratio_p5, {q6('min(ratio)')} AS ratio_min, {q6('avg((ratio > 1)::INT)')} AS share_above_1, {q6('avg((most >= off_)::INT)')} AS share_overlap FROM r",
)
def society_set_dispersion(spark, sf):
    """Dispersion of three societies over every choice of seven of nine topics in each: 36 ** 3 combinations, both media."""
    z = lambda df, name: df.select("society", "t1", "t2", F.atanh(F.least("y", F.lit(1 - 1e-12))).alias("y"))
    off, on = (subsets.subset_means(z(part_correlations(spark, sf, 9, m), m), _names(9), 7).select("society", "subset", F.col("mean").alias(m)) for m in ("off", "on"))
    grid = subsets.dispersion_grid(off.join(on, ["society", "subset"]), ("AMERICA", "ASIA", "EUROPE"))
    return rounded(subsets.dispersion_summary(grid).select(*_DISPERSION), *_DISPERSION[1:])


# --- random draws -----------------------------------------------------------------------------------------------------
@query("shuffle_deviation", f"WITH {PAIRS} SELECT t1, t2, count(*) AS n, {q6('corr(x, y)')} AS r, TRUE AS near_closed_form FROM pairs GROUP BY ALL")
def shuffle_deviation(spark, sf):
    """Observed correlations, and whether 2,000 permutations agree with the exact mean 0 and sd 1 / sqrt(n - 1) within five of
    their standard errors."""
    d = resampling.shuffled_correlations(the_pairs(spark, sf), 2000)
    exact = 1 / F.sqrt((F.col("n") - 1).cast("double"))
    near = (F.abs("shuffled_mean") < 5 * exact / 2000**0.5) & (F.abs(F.col("shuffled_sd") / exact - 1) < 5 / 4000**0.5)
    return rounded(d.select("t1", "t2", "n", "r", near.alias("near_closed_form")), "r")


@query("semantic_rank_difference")
def semantic_rank_difference(spark, sf):
    """Semantic ranks of the topics by the words with an even id less those by the others, with a Bayesian bootstrap's limits."""
    v = ad.keyword_vectors(spark, sf)
    rows = v.select(F.when(F.col("word") % 2 == 0, "even").otherwise("odd").alias("source"), "topic", "word", "vector", "weight")
    return rounded(resampling.rank_differences(rows, "even", "odd"), "difference", "lo", "hi")


# --- density ----------------------------------------------------------------------------------------------------------
def _density(rows: str, points: int, bins: int = 4096) -> str:
    """SQL of ``curves.density_curve`` over ``rows`` (g, x, w)."""
    return (
        f"v AS ({rows}), s AS (SELECT g, min(x) AS lo, max(x) AS hi, sum(w) AS w1, sum(w*w) AS w2, sum(w*x)/sum(w) AS m FROM v GROUP BY g HAVING max(x) > min(x)), "
        f"h AS (SELECT g, lo, hi, w1, (hi-lo)/{bins} AS d, sum(w*(x-m)**2)/w1/(1 - w2/(w1*w1))*pow(w2/(w1*w1), 0.4) AS h2 FROM v JOIN s USING (g) GROUP BY g, lo, hi, w1, w2), "
        f"t AS (SELECT g, w, (x-lo)/d AS t, least(floor((x-lo)/d), {bins - 1}) AS b FROM v JOIN h USING (g)), "
        "mass AS (SELECT g, b, sum(m) AS mass FROM (SELECT g, b, w*(1-(t-b)) AS m FROM t UNION ALL SELECT g, b+1, w*(t-b) FROM t) GROUP BY ALL), "
        f"c AS (SELECT g, lo + j*(hi-lo)/{points - 1} AS x, sum(mass*exp(-1.0*((lo + j*(hi-lo)/{points - 1} - (lo + b*d))**2)/(2*h2)))/(w1*sqrt(2*pi()*h2)) AS density FROM mass JOIN h USING (g), (SELECT unnest(range({points})) AS j) GROUP BY g, j, lo, hi, w1, h2)"
    )


@query("density_curves", f"WITH {PAIRS}, {_density('SELECT t1 AS g, avg(x) AS x, 1.0 AS w FROM pairs GROUP BY t1, year', 50)} SELECT g AS t1, {q6('x')} AS x, {q6('density')} AS density FROM c")
def density_curves(spark, sf):
    rows = the_pairs(spark, sf).groupBy("t1", "year").agg(F.avg("x").alias("x"))
    return rounded(curves.density_curve(rows, "t1", "x"), "x", "density")


@query("weighted_density_curves", f"WITH {_density('SELECT l_returnflag AS g, l_extendedprice AS x, l_quantity AS w FROM lineitem', 240)} SELECT g AS l_returnflag, {q6('x')} AS x, round(density * 1e4, 6) + 0.0 AS density FROM c")
def weighted_density_curves(spark, sf):
    """Densities of prices weighted by quantity over all line items, per price of 10,000."""
    found = curves.density_curve(ad.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", 240, "l_quantity")
    return rounded(found.withColumn("density", F.col("density") * 1e4), "x", "density")


# --- lines ------------------------------------------------------------------------------------------------------------
SPANS = (0.3, 0.4, 0.5, 0.7)


def _lines(rows: str, points: int, spans: tuple[float, ...] = SPANS) -> str:
    """SQL of ``curves.local_lines`` over ``rows`` (g, x, y, w) for the fits raw and reweighted."""
    return (
        f"lv AS ({rows}), le AS (SELECT g, min(x) AS lo, max(x) AS hi, count(*) AS n FROM lv GROUP BY g), "
        f"lp AS (SELECT g, span, j, lo + j*((hi-lo)/{points - 1}) AS p, least(n, greatest(3, CAST(ceil(span*n) AS INT))) AS k FROM le, (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in spans)}]) AS span), (SELECT unnest(range({points})) AS j)), "
        "ld AS (SELECT g, span, j, p, k, x - p AS u, y, w, row_number() OVER (PARTITION BY g, span, j ORDER BY abs(x - p)) AS rk FROM lv JOIN lp USING (g)), "
        "lh AS (SELECT g, span, j, CASE WHEN max(abs(u)) > 0 THEN max(abs(u))*1.0001::DOUBLE ELSE 1.0 END AS h FROM ld WHERE rk <= k GROUP BY ALL), "
        "lq AS (SELECT g, span, j, p, u, y, w, pow(1 - pow(abs(u)/h, 3), 3) AS c FROM ld JOIN lh USING (g, span, j) WHERE abs(u) < h), "
        "lm AS (SELECT g, span, j, p, 'raw' AS fit, sum(c) AS a, sum(c*u) AS b, sum(c*u*u) AS cc, sum(c*y) AS t, sum(c*u*y) AS e FROM lq GROUP BY ALL UNION ALL SELECT g, span, j, p, 'reweighted', sum(c*w), sum(c*w*u), sum(c*w*u*u), sum(c*w*y), sum(c*w*u*y) FROM lq GROUP BY ALL), "
        "lf AS (SELECT g, span, fit, p AS x, CASE WHEN a <= 0 THEN NULL WHEN a*cc - b*b > 1e-12*greatest(a*cc, 1e-300) THEN (cc*t - b*e)/(a*cc - b*b) ELSE t/a END AS value FROM lm)"
    )


_WEIGHTED = (
    _KDE.replace("a.society, a.t1, a.t2, a.y,", "a.society, a.t1, a.t2, a.x, a.y,")
    .replace("SELECT society, y, CASE", "SELECT society, x, y, CASE")
    .replace("soc AS (SELECT CAST(year", "soc0 AS (SELECT CAST(year")
    .replace(", h AS (SELECT society", ", soc AS (SELECT * FROM soc0 WHERE x IS NOT NULL AND y IS NOT NULL), h AS (SELECT society", 1)
)  # only pairs with both values have a weight


@query("loess_spans", f"{_WEIGHTED}, {_lines('SELECT society AS g, x, y, w FROM z WHERE x IS NOT NULL AND y IS NOT NULL', 25)} SELECT g AS society, span, fit, {q6('x')} AS x, round(value, 4) + 0.0 AS value FROM lf")
def loess_spans(spark, sf):
    """Local lines of the pairs' |r| on their similarity for all spans, raw and reweighted to the reference's similarities."""
    rows = adjustment.density_ratio_weights(society_pairs(spark, sf).where("x is not null and y is not null"), "1996")
    found = curves.local_lines(rows, "society", "x", "y", {"raw": None, "reweighted": "w"}, SPANS)
    return rounded(found, "x").withColumn("value", F.round("value", 4) + 0.0)


@query("loess_prices", f"WITH {_lines('SELECT l_returnflag AS g, l_extendedprice/1000 AS x, l_tax*100 AS y, l_quantity AS w FROM lineitem', 9, (0.3, 0.7))} SELECT g AS l_returnflag, span, fit, round(x, 9) + 0.0 AS x, round(value, 4) + 0.0 AS value FROM lf")
def loess_prices(spark, sf):
    """The same over all line items: tax on price, raw and weighted by quantity."""
    rows = ad.table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_quantity").alias("w"))
    found = curves.local_lines(rows, "l_returnflag", "x", "y", {"raw": None, "reweighted": "w"}, (0.3, 0.7), 9)
    return found.withColumn("x", F.round("x", 9) + 0.0).withColumn("value", F.round("value", 4) + 0.0)


@query(
    "reweighted_lines",
    f"{_WEIGHTED}, b AS (SELECT society, 'raw' AS fit, x, y, 1.0 AS w FROM z UNION ALL SELECT society, 'reweighted', x, y, w FROM z WHERE society <> '1996'), s AS (SELECT society, fit, count(*) AS n, sum(w) AS w, sum(w*x) AS a, sum(w*y) AS b, sum(w*x*x) AS aa, sum(w*x*y) AS ab, sum(w*y*y) AS bb FROM b WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), m AS (SELECT *, aa-a*a/w AS sxx, ab-a*b/w AS sxy, bb-b*b/w AS syy FROM s) "
    f"SELECT society, fit, n, {q6('(b-sxy/sxx*a)/w')} AS intercept, {q6('sxy/sxx')} AS slope, {q6('sqrt((syy-sxy/sxx*sxy)/((n-2)*sxx))')} AS se, {q6('sxy/sxx*sxy/syy')} AS r2 FROM m",
)
def reweighted_lines(spark, sf):
    """Lines of |r| on similarity with their errors, for raw and reweighted pairs; their p values are in ``reweighted_p_values``."""
    return rounded(adjustment.reweighted_lines(society_pairs(spark, sf), "1996").drop("p"), "intercept", "slope", "se", "r2")


@query("reweighted_p_values")
def reweighted_p_values(spark, sf):
    return rounded(adjustment.reweighted_lines(society_pairs(spark, sf), "1996").select("society", "fit", "p"), "p")


@query("reweighted_similarity", f"{_WEIGHTED}, m AS (SELECT society, sum(w*x)/sum(w) AS mean, sum(w)**2/sum(w*w) AS ess FROM z WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY society) SELECT society, {q6('any_value(mean)')} AS mean, {q6('sqrt(sum(w*(x-mean)**2)/sum(w))')} AS sd, {q6('any_value(ess)')} AS ess FROM z JOIN m USING (society) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY society")
def reweighted_similarity(spark, sf):
    """Mean, sd and effective number of the similarities under the weights: near the reference's where reweighting works."""
    return rounded(adjustment.reweighted_similarity(society_pairs(spark, sf), "1996"), "mean", "sd", "ess")




# --- spans of words ---------------------------------------------------------------------------------------------------
@query("word_cloud_rank")
def word_cloud_rank(spark, sf):
    """Rank, effective rank, condition and largest singular values of all words' unit vectors."""
    return subspaces.singular_values(subspaces.gram_sums(ad.keyword_vectors(spark, sf)))


@query("word_cloud_expressibility")
def word_cloud_expressibility(spark, sf):
    """How well the words of one, two or three other topics express each topic, as centroid and as cloud."""
    return rounded(subspaces.expressibility(subspaces.gram_sums(ad.keyword_vectors(spark, sf)), [1, 2, 3]), "residual")


@query("word_cloud_energy", f"WITH u AS (SELECT label AS topic, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings) SELECT topic, count(*) AS words, {q6('sum(e[1] * e[1])')} AS first, {q6('sum(e[1] * e[2])')} AS second, {q6('sum(list_dot_product(e, e))')} AS trace FROM u GROUP BY topic")
def word_cloud_energy(spark, sf):
    """Entries and trace of each topic's sum of products."""
    g = subspaces.gram_sums(ad.keyword_vectors(spark, sf))
    d = F.sqrt(F.size("gram").cast("double")).cast("int")
    trace = F.aggregate(F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.get("gram", i * (d + 1))), F.lit(0.0), lambda s, v: s + v)
    return rounded(g.select("topic", "words", F.get("gram", F.lit(0)).alias("first"), F.get("gram", F.lit(1)).alias("second"), trace.alias("trace")), "first", "second", "trace")


# --- reliability ------------------------------------------------------------------------------------------------------
def _reliability_values(spark, sf):
    return part_opinions(spark, sf, 9).select("user_id", F.col("society").alias("source"), "topic", F.col("off").alias("value"))


@query("reliability_grid")
def reliability_grid(spark, sf):
    """Mean |r| of two regions, gap and ratio under errors: equal reliabilities with 500 draws, unequal ones with 50."""
    found = reliability.reliability_grid(_reliability_values(spark, sf), _names(9), "AMERICA", "ASIA", reliability.study_cells())
    return rounded(found, *[c for c in found.columns if c not in ("rho_a", "rho_b", "draws")])


@query(
    "reliability_baseline",
    f"WITH {_parts(9)}, m AS (SELECT society, avg(abs(r)) AS m FROM (SELECT a.society, a.topic AS t1, b.topic AS t2, corr(a.off_, b.off_) AS r FROM op a JOIN op b ON a.user_id = b.user_id AND a.society = b.society AND a.topic < b.topic GROUP BY ALL) GROUP BY society), "
    "x AS (SELECT (SELECT m FROM m WHERE society = 'AMERICA') AS a, (SELECT m FROM m WHERE society = 'ASIA') AS b) "
    f"SELECT {q6('a')} AS mean_a, {q6('b')} AS mean_b, {q6('a - b')} AS gap, {q6('a / b')} AS ratio FROM x",
)
def reliability_baseline(spark, sf):
    """The grid's first cell: no errors, from the sums of products by pattern of observed topics."""
    found = reliability.reliability_grid(_reliability_values(spark, sf), _names(9), "AMERICA", "ASIA", [(1.0, 1.0, 1)])
    return rounded(found.select("mean_a", "mean_b", "gap", "ratio"), "mean_a", "mean_b", "gap", "ratio")


# --- places ---------------------------------------------------------------------------------------------------------
def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(
    "gazetteer_places",
    f"WITH tok AS (SELECT doc_id, {_tokens('text')} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id AS code, {_tokens('text')} AS w FROM benchmark), "
    "gz AS (SELECT w[1:3] AS w, code, 0 AS level FROM b UNION ALL SELECT w[4:5], code, 1 FROM b UNION ALL SELECT w[6:6], code, 2 FROM b), "
    "g AS (SELECT array_to_string(w, ' ') AS place, len(w) AS n, arg_min(code, (level, code)) AS code, min(level) AS level FROM gz WHERE len(w) > 0 GROUP BY w), "
    "r AS (SELECT doc_id, s AS start, n, array_to_string(w[s+1:s+n], ' ') AS place FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM tok, (SELECT DISTINCT n FROM g))) "
    "SELECT doc_id, place, code, level, start::INT AS start, n::INT AS words FROM r JOIN g USING (place, n) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level, start + n DESC, n DESC, code, place) = 1",
)
def gazetteer_places(spark, sf):
    """What each document names of a gazetteer made of the benchmark's openings: three words first, then two, then single ones."""
    w = places.place_tokens(F.col("text"))
    levels = [F.struct(F.array_join(F.slice(w, a, n), " ").alias("place"), F.lit(k).alias("level")) for k, (a, n) in enumerate(((1, 3), (4, 2), (6, 1)))]
    gazetteer = ad.table(spark, sf, "benchmark").select(F.col("item_id").alias("code"), F.explode(F.array(*levels)).alias("p")).select("p.place", "code", "p.level")
    return places.gazetteer_matches(ad.table(spark, sf, "documents"), gazetteer, "doc_id", "text")


# --- missing entries --------------------------------------------------------------------------------------------------
MISSING = (0.0, 0.25, 0.5, 0.75, 0.9)


@query("simulation_grid")
def simulation_grid(spark, sf):
    """Spectral numbers of the customers' values when entries are taken away: two patterns, five shares, five repetitions."""
    rows = simulation.thinned(_reliability_values(spark, sf).drop("source"), MISSING, 5)
    found = spectral.spectra(rows, ("pattern", "missing", "rep"))
    return rounded(found, "pr", "erank", "srank")


@query(
    "thinned_entries",
    f"WITH {_parts(9)}, m AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS missing, unnest([{', '.join(repr(simulation.row_scale(1 - m)) for m in MISSING)}])::DOUBLE AS scale), r AS (SELECT unnest(range(5)) AS rep), "
    "h AS (SELECT rep, topic, (CAST('0x' || substr(md5('0:e:' || rep || ':' || user_id || ':' || topic), 1, 10) AS BIGINT) + 0.5)/1099511627776.0 AS e, -ln((CAST('0x' || substr(md5('0:u:' || rep || ':' || user_id), 1, 10) AS BIGINT) + 0.5)/1099511627776.0) AS a FROM op, r) "
    "SELECT pattern, missing, rep::INT AS rep, count(*) AS entries, count(DISTINCT topic) AS topics FROM h, m, (SELECT unnest(['random', 'rows']) AS pattern) WHERE e < CASE WHEN pattern = 'random' THEN 1 - missing ELSE least(1.0, scale * a) END GROUP BY ALL",
)
def thinned_entries(spark, sf):
    """How many entries each cell of the grid keeps."""
    rows = simulation.thinned(_reliability_values(spark, sf).drop("source"), MISSING, 5)
    return rows.groupBy("pattern", "missing", "rep").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("topic").alias("topics"))


from opinara.plans import sensitivity as _sensitivity  # noqa: E402, F401  (adds its queries)
